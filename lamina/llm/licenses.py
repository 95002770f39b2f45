"""Licence texts and notices in documents, by patience alignment with templates.

Words are runs of letters and digits, lower-cased. A text is aligned with a
template like this: words alike at both ends are paired off; words that occur
once in the text and once in the template are anchors; the longest sequence of
anchors that rises in both is taken, and the gaps between them are aligned in
the same way. Coverage is the share of the template's words that are paired.

A hit lies within a window of twice the template's words and some slack. A
template is only aligned where a window holds enough of its different words for
the coverage asked for, which is a necessary condition, so no hit is lost by it;
the windows of whole texts are looked at. A window is tried at the length of
the template first, so that two copies next to each other are two hits. Hits of
one template do not overlap; those of different templates may, but within a
family of templates (versions of a licence, say) only the one with most words
paired, then of the best coverage, is kept.

NULL texts count as empty. Rows may repeat; each gives its hits. Templates
without words match nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lamina.llm.common import bounded_batches, map_rows
from lamina.llm.license_texts import TABLE

WORD = re.compile(r"[^\W_]+")
COVERAGE = 0.8
SLACK = 8

TEMPLATES = tuple((name, text) for name, _, text in TABLE)
FAMILIES = {name: family for name, family, _ in TABLE}


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given in order of the first part, whose second part rises."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, value) in enumerate(pairs):
        place = bisect_left(tails, value)
        if place == len(tails):
            tails.append(value)
            at.append(k)
        else:
            tails[place], at[place] = value, k
        before[k] = at[place - 1] if place else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def aligned(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in the text, place in the template) of equal words, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        low, high, first, last = todo.pop()
        while low < high and first < last and text[low] == template[first]:
            out.append((low, first))
            low, first = low + 1, first + 1
        while low < high and first < last and text[high - 1] == template[last - 1]:
            high, last = high - 1, last - 1
            out.append((high, last))
        if low >= high or first >= last:
            continue
        own, other = Counter(text[low:high]), Counter(template[first:last])
        place = {w: k for k, w in enumerate(template[first:last], first) if other[w] == 1}
        anchors = rising([(k, place[w]) for k, w in enumerate(text[low:high], low) if own[w] == 1 and w in place])
        out += anchors
        for (a, b), (c, d) in zip([(low - 1, first - 1), *anchors], [*anchors, (high, last)]) if anchors else ():
            todo.append((a + 1, c, b + 1, d))
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, coverage: float):
        self.name, self.words, self.coverage = name, WORD.findall(text.lower()), coverage
        self.family = FAMILIES.get(name, name)
        self.vocabulary = set(self.words)
        self.window = 2 * len(self.words) + SLACK
        missing = int((1 - coverage) * len(self.words) + 1e-9)
        self.need = max(1, len(self.vocabulary) - missing)

    def starts(self, words: list[str]) -> np.ndarray:
        """Where a window begins that holds `need` different words of the template, the first of them at its start."""
        count = np.zeros(len(words) + 1, np.int64)
        seen: dict[str, int] = {}
        places = [k for k, w in enumerate(words) if w in self.vocabulary]
        for k in places:
            since = max(seen.get(words[k], -1), k - self.window) + 1
            count[since] += 1
            count[k + 1] -= 1
            seen[words[k]] = k
        enough = np.cumsum(count) >= self.need
        return np.array([k for k in places if enough[k]], np.int64)

    def hits(self, words: list[str], known: set[str]) -> list[tuple[int, int, int]]:
        """(first word, end, words paired) of each hit in a text."""
        if not self.words or len(self.vocabulary & known) < self.need:
            return []
        out, free = [], 0
        for start in self.starts(words).tolist():
            if start < free:
                continue
            for size in (len(self.words) + SLACK // 2, self.window):
                pairs = aligned(words[start:start + size], self.words)
                if pairs and pairs[0][0] == 0 and len(pairs) >= self.coverage * len(self.words):
                    free = start + pairs[-1][0] + 1
                    out.append((start, free, len(pairs)))
                    break
        return out


def closest(hits: list[tuple]) -> list[tuple]:
    """Hits (template, first word, end, words paired) without those that overlap a closer one of their family.

    Closer is who pairs more words, then a larger share of the template's; of equal ones the first in the text,
    then by name.
    """
    ranked = sorted(hits, key=lambda h: (-h[3], -h[3] / len(h[0].words), h[1], h[0].name))
    kept: dict[str, list[tuple[int, int]]] = {}  # by family, in order of the text; none overlaps another
    out: list[tuple] = []
    for hit in ranked:
        taken = kept.setdefault(hit[0].family, [])
        place = bisect_left(taken, (hit[1], hit[2]))
        if (place == 0 or taken[place - 1][1] <= hit[1]) and (place == len(taken) or hit[2] <= taken[place][0]):
            taken.insert(place, (hit[1], hit[2]))
            out.append(hit)
    return out


def scanned(docs: DataFrame, templates=TEMPLATES, coverage: float = COVERAGE, key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """(key, license, start, end, n_paired, n_words, coverage) of each hit; start and end count code points."""
    bounded_batches(docs.sparkSession)
    prepared = [Template(name, words, coverage) for name, words in templates]
    names = ["key", "license", "start", "end", "n_paired", "n_words", "coverage"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]

    def work(piece):
        out: list[list] = [[] for _ in names]
        for own, value in zip(piece["key"].to_pylist(), piece["text"].to_pylist()):
            words = [w.lower() for w in WORD.findall(value)]
            known = set(words)
            hits = [(t, *hit) for t in prepared for hit in t.hits(words, known)]
            if hits:
                spans = [m.span() for m in WORD.finditer(value)]
                for template, first, end, paired in closest(hits):
                    row = (own, template.name, spans[first][0], spans[end - 1][1], paired, len(template.words),
                           paired / len(template.words))
                    for column, cell in zip(out, row):
                        column.append(cell)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    chosen = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return map_rows(chosen, work, "text", "key long, license string, start int, end int, n_paired int, n_words int, "
                                          "coverage double")
