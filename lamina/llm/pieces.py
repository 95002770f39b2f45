"""SentencePiece segmentations: sampled without replacement, with inclusion chances, and decoded.

All ways to cut a text into vocabulary pieces make a lattice. A piece has a
weight, and a segmentation's chance is the product of its weights over the sum
of such products. `k` segmentations are drawn without replacement by the
Gumbel-top-k rule: every segmentation gets its log chance plus Gumbel noise, and
the k largest are taken. They are found best first, as an A-star search whose
estimate of a set of segmentations is exact:

* the largest of all is a plain draw from the lattice, and its perturbed value
  a Gumbel draw; all others are split into sets that share a prefix with it and
  go on with another piece;
* the largest perturbed value in such a set is a Gumbel draw at the log of the
  set's mass, cut off at the value of the parent;
* the set of the largest value is opened next: a draw from it is the next
  segmentation, and what remains of it is split in the same way.

With the value of the best set still closed as threshold t, a segmentation of
log chance c was in the sample with chance 1 - exp(-exp(c - t)). That is given as
its logarithm: of a long text each single segmentation is very improbable.

No piece has a space after a letter, so the lattice of a text is a chain of
lattices of units (spaces and what follows them up to the next space). Units
are built once for a task and kept, up to a bound; the draws of all texts of a
batch go on side by side in numpy. Noise is a hash of seed, row key, turn and
place: a row is sampled alike wherever and however often it is.

NULL text counts as empty; it has one segmentation, without pieces. A text with
fewer than k segmentations gives all of them, with log inclusion 0. The
model reads U+2581 as a space, so that is what it is decoded to.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lamina.llm.common import bounded_batches, held, slices

SPACE = "▁"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SAMPLES = 2
SPREAD = 20


def mix(x: np.ndarray) -> np.ndarray:
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, both excluded."""
    return ((mix(x) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0 ** -52


def cut_off(location, bound, u):
    """A Gumbel draw at `location`, given that it is below `bound`."""
    return location - np.log(np.exp(location - bound) - np.log(u))


def log_inclusion(above: float) -> float:
    """Log of the chance 1 - exp(-exp(above)) that a value perturbed by Gumbel noise exceeds the threshold."""
    if above < -30:
        return above
    return float(np.log(-np.expm1(-np.exp(above)))) if above < 5 else 0.0


class Vocabulary:
    """Pieces and weights of a SentencePiece model.

    A unigram model's scores are log weights. A BPE model's scores count its
    merges, the first is the most frequent: rank r gets the weight 1 / (r + 2).
    `sharpness` is a power of the weights.
    """

    def __init__(self, path: str, sharpness: float = 0.5):
        import sentencepiece

        self.path, self.sharpness = path, sharpness
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        scores = np.array([model.get_score(i) for i in range(size)])
        plain = [i for i in range(size) if not (
            model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ranked = len(plain) > 1 and np.all(scores[plain] <= 0) and np.all(scores[plain] == np.round(scores[plain]))
        weights = 1 / (np.minimum(-scores, size) + 2) if ranked else np.exp(scores)
        self.size, self.piece_id = size, {model.id_to_piece(i): i for i in plain}
        self.weight = weights ** sharpness
        self.least = float(self.weight[plain].min())
        self.branch, self.child, self.whole = self.tree()
        self.place, self.crowded = self.hashed()
        self.cut, self.stop, self.kinds = self.borders()
        self.byte_id = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.shown = np.full(size, b"", object)
        for piece, i in self.piece_id.items():
            self.shown[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.byte_id.items():
            self.shown[i] = bytes([value])

    def __reduce__(self):
        return vocabulary_of, (self.path, self.sharpness)

    def tree(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The prefixes of all pieces as states: sorted (state, next character), the state there, a state's piece."""
        state_of, whole = {"": 0}, [-1]
        for piece in sorted(self.piece_id):
            for size in range(1, len(piece) + 1):
                if piece[:size] not in state_of:
                    state_of[piece[:size]] = len(whole)
                    whole.append(-1)
            whole[state_of[piece]] = self.piece_id[piece]
        pairs = sorted((state_of[p[:-1]] << 21 | ord(p[-1]), n) for p, n in state_of.items() if p)
        keys, states = zip(*pairs)
        return np.array(keys, np.int64), np.array(states, np.int64), np.array(whole, np.int64)

    def hashed(self) -> tuple[np.ndarray, np.ndarray]:
        """A place in `branch` for each hash of a key, and whether several keys have that hash."""
        spots = self.spread(self.branch)
        place = np.zeros(1 << SPREAD, np.int32)
        place[spots] = np.arange(len(spots))
        return place, np.bincount(spots, minlength=1 << SPREAD) > 1

    @staticmethod
    def spread(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * GOLDEN >> np.uint64(64 - SPREAD)).view(np.int64)

    def following(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For (state, next character) the place in `branch`, and whether it is there."""
        spread = self.spread(keys)
        spot = self.place[spread].astype(np.int64)
        there = self.branch[spot] == keys
        unsure = np.flatnonzero(~there & self.crowded[spread])
        if len(unsure):
            spot[unsure] = np.minimum(np.searchsorted(self.branch, keys[unsure]), len(self.branch) - 1)
            there[unsure] = self.branch[spot[unsure]] == keys[unsure]
        return spot, there

    def units(self, text: str) -> list[str]:
        """The units of a text; a text without characters has none."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        if not self.cut:
            return [text]
        return [unit for part in self.stop.split(text) for unit in self.cut.findall(part)]

    def borders(self):
        """Patterns for the units, which end only where no piece runs on, and the same as kinds of bytes.

        `cut` finds units that begin with spaces, or are white space that no
        piece has. `stop` is between a Latin letter and a mark that no piece
        has right after a letter.
        """
        if any(SPACE in p.lstrip(SPACE) for p in self.piece_id):
            return None, None, None
        letters = "A-Za-zÀ-ÖØ-öø-ɏ"
        after = set("".join(re.findall(f"(?<=[{letters}])[!-~]", " ".join(self.piece_id))))
        marks = "".join(re.escape(chr(c)) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in after)
        alone = re.escape("".join(c for c in "\n\r\t" if not any(c in p for p in self.piece_id)))
        ways = [f"{SPACE}+[^{SPACE}{alone}]*", f"[^{SPACE}{alone}]+"] + ([f"[{alone}]+"] if alone else [])
        stop = f"(?<=[{letters}])(?=[{marks}])" if marks else "(?!)"
        kinds = np.zeros(256, np.uint8)  # 1 space, 2 alone, 4 mark, 8 letter
        for bit, chars in ((1, " "), (2, [c for c in "\n\r\t" if not any(c in p for p in self.piece_id)]),
                           (4, [chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in after]),
                           (8, [chr(c) for c in (*range(65, 91), *range(97, 123))])):
            for char in chars:
                kinds[ord(char)] |= bit
        return re.compile("|".join(ways)), re.compile(stop), kinds

    def units_of(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, list[bytes]]:
        """The units of many texts in one array, where each text begins and ends in it, and each text as the model reads it.

        The borders are those of `units`, found in the bytes of all texts at once. Units begin with a plain space here.
        """
        plain = pc.replace_substring(texts, SPACE, " ")
        led = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(plain), 0), "", " "), plain, "")
        ends = np.frombuffer(led.buffers()[1], np.int32)[led.offset:led.offset + len(led) + 1]
        data = np.frombuffer(led.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
        ends = ends - ends[0]
        raw = data.tobytes()
        wanted = [raw[a + 1:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        if not self.cut:
            held = [" " + w.decode("utf-8", "surrogatepass") if b > a else None
                    for w, a, b in zip(wanted, ends[:-1].tolist(), ends[1:].tolist())]
            counts = np.array([h is not None for h in held], np.int64)
            return pa.array([h for h in held if h is not None], pa.string()), np.concatenate(([0], np.cumsum(counts))), wanted
        begins = np.zeros(len(data) + 1, bool)
        begins[ends] = True
        kind = self.kinds[data]
        space, alone, mark = (kind & bit > 0 for bit in (1, 2, 4))
        letter = kind & 8 > 0
        # A Latin letter of two bytes ends at its second: C3 80 to C9 8F, less the signs for times and divided by.
        second = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9)) + 1
        code = ((data[second - 1] & 0x1F).astype(np.int32) << 6) | (data[second] & 0x3F)
        letter[second[(code <= 0x24F) & (code != 0xD7) & (code != 0xF7)]] = True
        begins[1:-1] |= (space[1:] & ~space[:-1]) | (alone[1:] != alone[:-1]) | (letter[:-1] & mark[1:])
        starts = np.flatnonzero(begins[:-1])
        offsets = np.append(starts, len(data)).astype(np.int32)
        units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw))
        return units, np.searchsorted(starts, ends), wanted

    def joined(self, ids: np.ndarray) -> bytes:
        """What the ids stand for, without the space that every text is begun with."""
        return b"".join(self.shown[ids].tolist()).removeprefix(b" ")

    def decode(self, ids) -> str:
        return self.joined(np.asarray(ids, np.int64)).decode("utf-8", "replace")


def beside(chance: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For each edge the sum of the others of its node, small ones included; edges of a node fall in chance."""
    out = np.zeros(len(chance))
    counts = np.diff(firsts)
    alone = np.add.reduceat(np.append(chance, 0.0), firsts[:-1])
    place = np.arange(len(chance)) - np.repeat(firsts[:-1], counts)
    np.copyto(out, np.repeat(alone, counts) - chance, where=place > 0)  # the greatest is among these others
    without = chance.copy()
    without[firsts[:-1]] = 0.0
    out[firsts[:-1]] = np.add.reduceat(np.append(without, 0.0), firsts[:-1])
    return out


def falling(chance: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The order in which the edges of each node fall in chance, equal ones as they stand. Nodes of as many edges go together."""
    order, counts = np.arange(len(chance)), np.diff(firsts)
    for many in np.unique(counts[counts > 1]).tolist():
        own = firsts[:-1][counts == many][:, None] + np.arange(many)
        order[own] = np.take_along_axis(own, np.argsort(-chance[own], axis=1, kind="stable"), axis=1)
    return order


class Lattices:
    """The lattices of units, as arrays: nodes with edges, edges with chance, end node and piece.

    A node's edges stand in order of falling chance. Pieces at or above the size of the
    vocabulary are characters spelt in bytes (`spelt`). End node -1 ends a unit.
    """

    def __init__(self, vocabulary: Vocabulary, room: int = 4_000_000):
        self.vocabulary, self.room = vocabulary, room
        self.clear()
        self.first = np.zeros(1 << 12, np.int64)
        self.chance, self.up_to = np.zeros(1 << 14), np.zeros(1 << 14, np.float32)
        self.others = np.zeros(1 << 14)  # the chance of all other edges of the node
        self.end, self.piece = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def clear(self) -> None:
        """Forget all units; the arrays are filled anew from their start."""
        self.node_of: dict[str, int] = {}
        self.spelt: list[tuple[int, ...]] = []
        self.spelling: dict[str, int] = {}
        self.nodes = self.edges = 0

    def spell(self, char: str) -> int:
        """The piece of a character that is no piece: its byte, or a spelling in several bytes."""
        data = char.encode()
        if len(data) == 1 and data[0] in self.vocabulary.byte_id:
            return self.vocabulary.byte_id[data[0]]
        if char not in self.spelling:
            self.spelling[char] = self.vocabulary.size + len(self.spelt)
            self.spelt.append(tuple(self.vocabulary.byte_id.get(b, 0) for b in data))
        return self.spelling[char]

    def steps(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        """All edges (to, piece, log weight) between characters of units that end at `stop`, and each character's first.

        They stand by character; those of one character as they are found, by length.
        """
        own = self.vocabulary
        logs = np.log(own.weight)
        start, state, at = np.arange(len(codes)), np.zeros(len(codes), np.int64), np.arange(len(codes))
        out, counts = [], np.zeros(len(codes), np.int64)  # of a round there is one edge at most for each character

        def note(start, to, piece, log):
            out.append((start, counts[start], to, piece, log))
            counts[start] += 1

        while len(start):
            spot, going = own.following(state << 21 | codes[at])
            start, at, state = start[going], at[going] + 1, own.child[spot[going]]
            piece = own.whole[state]
            full = np.flatnonzero(piece >= 0)
            note(start[full], at[full], piece[full], logs[piece[full]])
            if len(out) == 1:
                lone = np.flatnonzero(counts == 0)
            inside = np.flatnonzero(at < stop[start])
            start, at, state = start[inside], at[inside], state[inside]
        chars, which = np.unique(codes[lone], return_inverse=True)
        spelt = np.array([self.spell(chr(c)) for c in chars.tolist()], np.int64)
        sizes = np.array([len(chr(c).encode()) for c in chars.tolist()], np.int64)
        note(lone, lone + 1, spelt[which], sizes[which] * np.log(own.least))

        firsts = np.concatenate(([0], np.cumsum(counts)))
        to, piece, log = np.empty(firsts[-1], np.int64), np.empty(firsts[-1], np.int64), np.empty(firsts[-1])
        for start, rank, *values in out:
            place = firsts[start] + rank
            for column, value in zip((to, piece, log), values):
                column[place] = value
        return to, piece, log, firsts

    def nodes_of(self, units: pa.Array) -> np.ndarray:
        """The first node of each unit. Arrow finds the different units; only they are looked up."""
        coded = units.dictionary_encode()
        firsts = self.add(coded.dictionary.to_pylist())
        return firsts[coded.indices.to_numpy(zero_copy_only=False)]

    def add(self, units: list[str]) -> np.ndarray:
        """The first nodes of different units. Those not known yet are built; all are forgotten first if there is no room."""
        known = self.node_of.get
        out = np.array([known(u, -1) for u in units], np.int64)
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out
        if self.edges > self.room:
            self.clear()
            missing = np.arange(len(units))
        fresh = [units[i] for i in missing.tolist()]
        # Units begin with a plain space, which the pieces have as their own sign.
        joined = "".join(fresh).replace(" ", SPACE)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        stops = np.cumsum(sizes)
        stop = np.repeat(stops, sizes)
        to, piece, log, firsts = self.steps(codes, stop)
        counts = np.diff(firsts)
        last = to == np.repeat(stop, counts)

        # The log mass of a node is the sum over its edges; nodes go from the ends of units backwards.
        far = stop - np.arange(len(codes))
        nodes = np.argsort(far.astype(np.uint16) if far.max() < 1 << 16 else far, kind="stable")
        heads = np.concatenate(([0], np.cumsum(counts[nodes])))
        order = np.repeat(firsts[nodes] - heads[:-1], counts[nodes]) + np.arange(len(to))
        onward = np.where(last, len(codes), to)  # the mass beyond a unit's end is 0
        log_of, onward_of = log[order], onward[order]
        mass = np.zeros(len(codes) + 1)
        cuts = np.searchsorted(far[nodes], np.arange(1, int(far.max()) + 2))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if low == high:
                continue
            begin, end = heads[low], heads[high]
            value = log_of[begin:end] + mass[onward_of[begin:end]]
            groups = heads[low:high] - begin
            top = np.maximum.reduceat(value, groups)
            total = np.add.reduceat(np.exp(value - np.repeat(top, counts[nodes[low:high]])), groups)
            mass[nodes[low:high]] = top + np.log(total)
        chance = np.exp(log + mass[onward] - np.repeat(mass[:-1], counts))

        order = falling(chance, firsts)
        to, piece, chance, last = to[order], piece[order], chance[order], last[order]
        run = np.concatenate(([0.0], np.cumsum(chance)))
        up_to = run[1:] - np.repeat(run[firsts[:-1]], counts)
        up_to[firsts[1:] - 1] = 1.0
        others = beside(chance, firsts)

        out[missing] = self.nodes + stops - sizes
        self.node_of.update(zip(fresh, out[missing].tolist()))
        node, total = self.nodes + len(codes), self.edges + len(chance)
        self.first = self.grown(self.first, node + 1)
        self.first[self.nodes:node + 1] = self.edges + firsts
        ends = np.where(last, -1, self.nodes + to)
        for name, values in (("chance", chance), ("up_to", up_to), ("others", others), ("end", ends), ("piece", piece)):
            array = self.grown(getattr(self, name), total)
            array[self.edges:total] = values
            setattr(self, name, array)
        self.nodes, self.edges = node, total
        return out

    @staticmethod
    def grown(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        out = np.empty(max(size, len(array) * 3 // 2), array.dtype)  # what is not used yet takes no memory
        out[:len(array)] = array
        return out

    def draw(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A path from each node to the end of its unit: all edges in order, and how many each path has."""
        active, where, rounds = np.arange(len(nodes)), nodes, []
        lengths = np.zeros(len(nodes), np.int64)
        state = keys
        while len(active):
            state = state + GOLDEN
            u = uniform(state)
            edge = self.first[where]
            late = np.flatnonzero(u >= self.up_to[edge])
            while len(late):
                edge[late] += 1
                late = late[u[late] >= self.up_to[edge[late]]]
            rounds.append((active, edge))
            lengths[active] += 1
            where = self.end[edge].astype(np.int64)
            going = np.flatnonzero(where >= 0)
            active, where, state = active[going], where[going], state[going]
        offsets = np.cumsum(lengths) - lengths
        path = np.empty(int(lengths.sum()), np.int64)
        for step, (who, edge) in enumerate(rounds):
            path[offsets[who] + step] = edge
        return path, lengths

    def ids(self, path: np.ndarray) -> np.ndarray:
        pieces = self.piece[path]
        size = self.vocabulary.size
        special = np.flatnonzero(pieces >= size)
        if not len(special):
            return pieces
        sizes = np.ones(len(pieces), np.int64)
        words = [self.spelt[p - size] for p in pieces[special].tolist()]
        sizes[special] = [len(w) for w in words]
        out = np.repeat(pieces, sizes)
        starts = np.cumsum(sizes) - sizes
        for at, word in zip(starts[special].tolist(), words):
            out[at:at + len(word)] = word
        return out


@lru_cache(maxsize=2)
def vocabulary_of(path: str, sharpness: float) -> Vocabulary:
    return Vocabulary(path, sharpness)


def lattices_of(vocabulary: Vocabulary) -> Lattices:
    """The lattices of this process: what one task has built serves the next."""
    return held(("lattices", vocabulary.path, vocabulary.sharpness), lambda: Lattices(vocabulary))


class Search:
    """The best-first search for one text: its found paths, and the sets still closed."""

    def __init__(self, key: int, units: np.ndarray):
        self.key, self.units = key, units  # units: first nodes
        self.paths: list[tuple] = []  # (edges, log chances before each edge and after the last, perturbed value)
        self.unit_ends: list[np.ndarray] = []  # for each path, the number of edges up to the end of each unit
        self.closed: list[tuple] = []  # (-value, number, path, place, edges left out)
        self.number = 0

    def close(self, value: float, path: int, place: int, out: tuple[int, ...]) -> None:
        self.number += 1
        heapq.heappush(self.closed, (-value, self.number, path, place, out))

    def note(self, k: int, path: tuple, ends: np.ndarray, places: np.ndarray, values: np.ndarray) -> None:
        """Keep a path, and close the sets beside its new edges, of which these places and perturbed values are told."""
        turn = len(self.paths)
        self.paths.append(path)
        self.unit_ends.append(ends)
        if len(values) > k:  # no more than k of them can be opened or give the threshold
            best = np.argpartition(-values, k)[:k]
            places, values = places[best], values[best]
        for place, own in zip(places.tolist(), values.tolist()):
            self.close(own, turn, place, (int(path[0][place]),))


def sample(lattices: Lattices, texts: list[list[str]], keys: np.ndarray, k: int) -> list[Search]:
    """Up to `k` segmentations for each text (a list of units), all texts side by side."""
    units = pa.array([u.replace(SPACE, " ") for units in texts for u in units], pa.string())
    return drawn(lattices, units, np.cumsum([0, *map(len, texts)]), keys, k)


def drawn(lattices: Lattices, units: pa.Array, cuts: np.ndarray, keys: np.ndarray, k: int) -> list[Search]:
    """The same for the units of all texts in one array, and where each text begins and ends in it."""
    nodes = lattices.nodes_of(units)
    cuts = cuts.tolist()
    searches = [Search(int(key), nodes[a:b]) for key, a, b in zip(keys, cuts, cuts[1:])]
    with np.errstate(over="ignore", divide="ignore"):
        jobs = []  # (search, first nodes, edges so far, log chances before them, value, unit ends so far)
        for search in searches:
            value = float(-np.log(-np.log(uniform(np.array([search.key], np.uint64) + np.uint64(77))))[0])
            jobs.append((search, search.units, np.zeros(0, np.int64), np.zeros(1), value, np.zeros(0, np.int64), False))
        for turn in range(k):
            advance(lattices, jobs, k, turn)
            jobs = []
            for search in searches if turn + 1 < k else []:
                if search.closed:
                    jobs.append(opened(lattices, search, turn + 1))
    return searches


def opened(lattices: Lattices, search: Search, turn: int) -> tuple:
    """Open the best closed set: draw the piece that goes on, close what remains of the set."""
    value, _, number, place, out = heapq.heappop(search.closed)
    value = -value
    edges, before, _ = search.paths[number]
    old = int(edges[place])
    node = int(np.searchsorted(lattices.first[:lattices.nodes + 1], old, side="right")) - 1
    choice = [e for e in range(lattices.first[node], lattices.first[node + 1]) if e not in out]
    mass = float(lattices.chance[choice].sum())
    shares = lattices.chance[choice] / mass if mass > 0 else lattices.chance[choice]
    noise = uniform(np.uint64(search.key) + np.uint64(turn) * np.uint64(0xA0761D6478BD642F)
                    + np.array([1, 2], np.uint64) * GOLDEN)
    reach = np.cumsum(shares) > noise[0]
    edge = choice[int(np.argmax(reach)) if reach.any() else -1]
    left = float(sum(lattices.chance[e] for e in choice if e != edge))  # not 1 - chance, which would lose small ones
    if left > 0:
        own = cut_off(before[place] + np.log(left), value, noise[1])
        search.close(float(own), number, place, (*out, edge))
    ends = search.unit_ends[number]
    unit = int(np.searchsorted(ends, place, side="right"))
    further = int(lattices.end[edge])
    nodes = search.units[unit + 1:]
    if further >= 0:
        nodes = np.concatenate(([further], nodes))
    head = np.append(edges[:place], edge)
    so_far = np.append(before[:place + 1], before[place] + np.log(lattices.chance[edge]))
    done = ends[:unit] if further >= 0 else np.append(ends[:unit], place + 1)
    return search, nodes, head, so_far, value, done, True


def advance(lattices: Lattices, jobs: list[tuple], k: int, turn: int) -> None:
    """Draw the rest of each path: all nodes of all texts at once."""
    if not jobs:
        return
    nodes = np.concatenate([job[1] for job in jobs])
    salts = [np.uint64(job[0].key) ^ mix(np.uint64(turn + 1) * GOLDEN
             + (np.arange(len(job[1]), dtype=np.uint64) << np.uint64(20))) for job in jobs]
    path, lengths = lattices.draw(nodes, np.concatenate(salts))
    logs = np.log(lattices.chance[path])
    steps = np.concatenate(([0], np.cumsum(lengths)))
    cuts = steps[np.cumsum([0, *(len(job[1]) for job in jobs)])]
    found, at = [], 0
    for (search, own, head, before, value, done, _), begin, end in zip(jobs, cuts[:-1].tolist(), cuts[1:].tolist()):
        edges = np.concatenate((head, path[begin:end]))
        chances = np.concatenate((before, before[-1] + np.cumsum(logs[begin:end])))
        found.append(((edges, chances, value), np.concatenate((done, len(head) - begin + steps[at + 1:at + len(own) + 1]))))
        at += len(own)

    # The sets beside the new edges of all texts: each edge's others, perturbed below the value of its path.
    rest = lattices.others[path]
    beside_them = np.flatnonzero(rest > 0)
    counts, fresh = np.diff(cuts), np.array([len(job[2]) for job in jobs])
    which = np.repeat(np.arange(len(jobs)), counts)[beside_them]
    places = beside_them - cuts[which] + fresh[which]
    location = np.concatenate([own[1][n:-1] for (own, _), n in zip(found, fresh.tolist())])[beside_them] + np.log(rest[beside_them])
    keys = np.array([job[0].key for job in jobs], np.uint64) + np.array(
        [len(job[0].paths) + 1 for job in jobs], np.uint64) * np.uint64(0xD1342543DE82EF95)
    u = uniform(keys[which] + places.astype(np.uint64) * GOLDEN)
    values = cut_off(location, np.array([job[4] for job in jobs])[which], u)
    borders = np.searchsorted(beside_them, cuts).tolist()
    for job, (own, ends), a, b in zip(jobs, found, borders, borders[1:]):
        job[0].note(k, own, ends, places[a:b], values[a:b])


def encoded(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", k: int = SAMPLES, seed: int = 7,
            sharpness: float = 0.5) -> DataFrame:
    """(key, sample, ids, log_chance, perturbed, log_inclusion, exact): up to `k` rows for each row of `docs`.

    `exact` tells whether the ids decode to the text.
    """
    bounded_batches(docs.sparkSession)
    vocabulary = Vocabulary(model, sharpness)
    names = ["key", "sample", "ids", "log_chance", "perturbed", "log_inclusion", "exact"]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]

    def shown(out: list[list]) -> pa.RecordBatch:
        columns = [pa.array(c, t) if t != kinds[2] else None for c, t in zip(out, kinds)]
        offsets = np.cumsum([0, *map(len, out[2])])
        flat = np.concatenate([*out[2], np.zeros(0, np.int64)]).astype(np.int32)
        columns[2] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        lattices = lattices_of(vocabulary)
        for piece in slices(batches, "text", 1 << 19):
            units, cuts, wanted = vocabulary.units_of(piece["text"])
            keys = piece["noise"].to_numpy(zero_copy_only=False).view(np.uint64)
            found = drawn(lattices, units, cuts, keys, k)
            out: list[list] = [[] for _ in names]
            held = 0
            for own, value, search in zip(piece["key"].to_pylist(), wanted, found):
                bound = -search.closed[0][0] if search.closed else -np.inf
                for number, (edges, before, perturbed) in enumerate(search.paths, 1):
                    ids = lattices.ids(edges)
                    chance = float(before[-1])
                    inclusion = log_inclusion(chance - bound)
                    exact = vocabulary.joined(ids) == value
                    held += len(ids)
                    for column, cell in zip(out, (own, number, ids, chance, perturbed, inclusion, exact)):
                        column.append(cell)
                if held > 1 << 19:
                    yield shown(out)
                    out, held = [[] for _ in names], 0
            yield shown(out)

    chosen = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"),
                         F.xxhash64(F.lit(seed), F.col(key)).alias("noise"))
    return chosen.mapInArrow(run, "key long, sample int, ids array<int>, log_chance double, perturbed double, "
                                  "log_inclusion double, exact boolean")


def decoded(rows: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """`rows` with the text that their ids stand for; NULL for NULL ids."""
    vocabulary = Vocabulary(model)

    @F.pandas_udf("string")
    def read(values):
        return values.map(lambda own: None if own is None else vocabulary.decode(own.tolist()))

    return rows.withColumn(text, read(F.col(ids)))
