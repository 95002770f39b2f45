"""The table of licence notices, headers and whole texts that `licenses` looks for, each held whole.

(name, family, text). Where hits of one family overlap, only the closest is
kept: their texts differ in a word or two, or one holds the other.
"""

from __future__ import annotations

MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE.")
ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
    "OR PERFORMANCE OF THIS SOFTWARE.")
BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. ")
BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. ")
BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def gnu_header(name: str, version: str) -> str:
    """The notice that the GNU licences ask for in each file."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} "
        f"as published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
        f"later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} "
        f"for more details. You should have received a copy of the GNU {name} along with this program. If not, see "
        f"<https://www.gnu.org/licenses/>.")


GNU = (
    ("gpl-2", "General Public License", "2"), ("gpl-3", "General Public License", "3"),
    ("lgpl-2.1", "Lesser General Public License", "2.1"), ("lgpl-3", "Lesser General Public License", "3"),
    ("agpl-3", "Affero General Public License", "3"),
)
CC = (
    ("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"),
    ("by-nc", "Attribution-NonCommercial"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
    ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
)

TABLE = (
    ("all-rights-reserved", "reserved", "All rights reserved."),
    ("apache-2.0-notice", "apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "apache-header",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
     "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
     "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
     "specific language governing permissions and limitations under the License."),
    *((f"cc-{kind}-{version}-notice", "cc-notice", f"Licensed under CC {kind.upper()} {version}.")
      for kind, _ in CC for version in ("4.0", "3.0")),
    *((f"cc-{kind}-4.0-long-notice", "cc-long",
       f"This work is licensed under a Creative Commons {name} 4.0 International License.") for kind, name in CC),
    *((f"cc-{kind}-3.0-long-notice", "cc-long",
       f"This work is licensed under a Creative Commons {name} 3.0 Unported License.") for kind, name in CC),
    ("cc0-1.0-notice", "cc0",
     "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
     "work."),
    *((f"{key}-notice", "gnu-notice", f"This work is licensed under the GNU {name}, version {version}.")
      for key, name, version in GNU),
    *((f"{key}-header", "gnu-header", gnu_header(name, version)) for key, name, version in GNU),
    ("mpl-2.0-header", "mpl",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("isc", "isc",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies. " + ISC_WARRANTY),
    ("0bsd", "isc",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted. " + ISC_WARRANTY),
    ("mit-notice", "notice", "Released under the MIT License."),
    ("isc-notice", "notice", "Released under the ISC License."),
    ("bsd-notice", "notice", "Released under the BSD License."),
    ("mit", "mit",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
     "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
     "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software. " + MIT_WARRANTY),
    ("bsd-2-clause", "bsd", BSD_CONDITIONS + BSD_WARRANTY),
    ("bsd-3-clause", "bsd", BSD_CONDITIONS + BSD_NAMES + BSD_WARRANTY),
    ("bsl-1.0", "bsl",
     "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
     "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
     "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
     "to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software "
     "and this entire statement, including the above license grant, this restriction and the following disclaimer, must "
     "be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless "
     "such copies or derivative works are solely in the form of machine-executable object code generated by a source "
     "language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
     "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND "
     "NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY "
     "DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
     "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("unlicense", "unlicense",
     "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
     "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author "
     "or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
     "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
     "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
     "software under copyright law. " + MIT_WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")),
)
