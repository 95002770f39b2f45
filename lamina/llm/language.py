"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text tells which strings occur
in it. A text is parsed from left to right into phrases, each the longest match
in the language's text; a letter that the language does not have is a phrase of
its own. The fewer phrases a language needs for a text, the more the text is
like it, and the language of the fewest phrases for each letter wins; of equal
ones the first by name.

Learning uses a bounded sample: `excerpts` texts of each language, those whose
hash comes first, and of each the `letters` letters around its middle. So the
automata have at most 2 * excerpts * (letters + 1) states each, and what a task
holds does not grow with the corpus. Letters are lower-cased, everything else
is a space and spaces run together. Every letter of the sample is known; the
most frequent ones have columns in a table of `CELLS` cells, the transitions of
the others are looked up in a sorted list.

Whole texts are parsed as one sequence each, however long. To go on side by
side, a text is divided into blocks of `BLOCK` letters; each begins in the state
in which a parse of the `WARM` letters before it ends, and is parsed again where
the block before it turns out to end in another. So the phrases are those of
the parse from left to right, wherever blocks end.

A text that is NULL or without a letter is `und`, with score 0. The score is how
much the second-best language exceeds the best in phrases, as a share of the
second-best's; with a single language it is 1.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lamina.llm.common import all_but, bounded_batches, free_name, held, map_rows, quoted

UNDETERMINED = "und"
EXCERPTS = 100
LETTERS = 160
CELLS = 1 << 25
BLOCK = 256
WARM = 64
LANES = 1 << 14


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code point of the lower-case letter for each code point, 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters, with a 0 for each run of anything else between them."""
    codes = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    codes = codes[keep]
    return codes[:-1] if len(codes) and codes[-1] == 0 else codes


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence: its paths from state 0 are all that occurs in it."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text:
        state = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = state
            at = link[at]
        if at >= 0:
            target = moves[at][symbol]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                while at >= 0 and moves[at].get(symbol) == target:
                    moves[at][symbol] = copy
                    at = link[at]
                link[target] = link[state] = copy
        last = state
    return moves


class Parser:
    """All languages' automata in one table, with a list for rare letters.

    Row state * width + symbol holds four times the row of the next state, plus
    the phrases that this symbol completes: the one before it if it does not go
    on, and the symbol itself if the language does not have it. Symbol 0 is a
    space, `width` - 2 an unseen letter, and `width` - 1 no symbol at all, which
    leaves the state. Symbols from `width` on are the letters without a column.
    """

    def __init__(self, samples: dict[str, list[str]], cells: int = CELLS):
        self.samples, self.cells = samples, cells
        self.names = sorted(samples)
        texts = {name: [letters_of(t) for t in samples[name]] for name in self.names}
        everything = [own for name in self.names for own in texts[name]]
        codes, counts = np.unique(np.concatenate([*everything, np.zeros(0, np.uint32)]), return_counts=True)
        letters = codes[np.argsort(-counts, kind="stable")]
        letters = letters[letters > 0]
        rank = np.zeros(0x110000, np.int64)
        rank[letters] = np.arange(1, len(letters) + 1)
        automata = []
        for name in self.names:
            joined: list[int] = []
            for own in texts[name]:
                joined += rank[own].tolist() + [0]
            automata.append(automaton(joined))
        dense = min(len(letters), cells // max(1, sum(map(len, automata))))
        self.width = dense + 3
        self.symbol = np.full(0x110000, self.width - 2, np.int32)
        self.symbol[0] = 0
        number = np.arange(1, len(letters) + 1)
        self.symbol[letters] = np.where(number <= dense, number, number + 2)
        self.build(automata, dense, len(letters) - dense)

    def __reduce__(self):
        return parser_of, (tuple((n, tuple(self.samples[n])) for n in self.names), self.cells)

    def build(self, automata: list[list[dict[int, int]]], dense: int, rare: int) -> None:
        parts, roots, base = [], [], 0
        width = self.width
        keys: list[int] = []
        values: list[int] = []
        self.span = width + rare
        self.fresh = np.full((len(automata), rare), -1, np.int64)
        for language, moves in enumerate(automata):
            table = np.full((len(moves), width), -1, np.int64)
            for state, out in enumerate(moves):
                for symbol, target in out.items():
                    if symbol <= dense:
                        table[state, symbol] = target
                    else:
                        keys.append((base + state) * self.span + symbol + 2)
                        values.append((base + target) * width)
                        if state == 0:
                            self.fresh[language, symbol - dense - 1] = (base + target) * width
            absent = table[0] < 0
            fresh = np.where(absent, 0, table[0])
            done = (table < 0).astype(np.int64)
            table = np.where(done > 0, fresh[None, :], table)
            done[1:, absent] += 1
            table[:, -1], done[:, -1] = np.arange(len(moves)), 0
            parts.append(((table + base) * width * 4 + done).ravel())
            roots.append(base * width)
            base += len(moves)
        kind = np.int32 if base * width * 4 < 1 << 31 else np.int64
        self.tables, self.roots = np.concatenate(parts or [np.zeros(0)]).astype(kind), np.array(roots, kind)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.next = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]

    def beyond(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states (languages x lanes) at letters without a column, and the phrases these complete."""
        key = state.astype(np.int64) // self.width * self.span + symbols[None, :]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        goes_on = self.keys[at] == key
        root = self.roots[:, None]
        fresh = self.fresh[:, symbols - self.width]
        done = (~goes_on & (state != root)).astype(np.int32) + (fresh < 0)
        return np.where(goes_on, self.next[at], np.where(fresh < 0, root, fresh)), done

    def phrases(self, blocks: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (languages x blocks) that end in blocks given as columns of symbols, and the states after them."""
        count = np.zeros(state.shape, np.int32)
        far = (blocks >= self.width).any(axis=1)
        for row, some in zip(blocks, far.tolist()):
            step = self.tables.take(state + (np.minimum(row, self.width - 1) if some else row)[None, :])
            count += step & 3
            after = step >> 2
            if some:
                lanes = np.flatnonzero(row >= self.width)
                after[:, lanes], done = self.beyond(state[:, lanes], row[lanes])
                count[:, lanes] += done
            state = after
        return count, state

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (languages x texts) and letters of each text."""
        symbols = [self.symbol[letters_of(t)] for t in texts]
        letters = np.array([int((s != 0).sum()) for s in symbols], np.int64)
        sizes = np.array([-(-len(s) // BLOCK) for s in symbols], np.int64)
        total = np.zeros((len(self.names), len(texts)), np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        if not len(owner) or not self.names:
            return total, letters
        flat = np.full(int(sizes.sum()) * BLOCK, self.width - 1, np.int32)
        at = 0
        for own, size in zip(symbols, sizes.tolist()):
            flat[at:at + len(own)] = own
            at += size * BLOCK
        blocks = flat.reshape(-1, BLOCK)

        def parsed(which, columns, entry):
            found = [
                self.phrases(np.ascontiguousarray(blocks[which[k:k + LANES], columns].T), entry[:, k:k + LANES])
                for k in range(0, len(which), LANES)]
            return [np.concatenate(side, axis=1) for side in zip(*found)]

        entry = np.repeat(self.roots[:, None], len(blocks), axis=1)
        later = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        if len(later):
            entry[:, later] = parsed(later - 1, slice(BLOCK - WARM, BLOCK), entry[:, later])[1]
        ended, state = parsed(np.arange(len(blocks)), slice(0, BLOCK), entry)
        rounds = 0
        while True:
            wrong = later[(entry[:, later] != state[:, later - 1]).any(axis=0)]
            if not len(wrong):
                break
            rounds += 1
            if rounds > 4:  # a parse that does not fall into step: its next block only, as those after it will change
                wrong = wrong[np.r_[True, owner[wrong][1:] != owner[wrong][:-1]]]
            entry[:, wrong] = state[:, wrong - 1]
            ended[:, wrong], state[:, wrong] = parsed(wrong, slice(0, BLOCK), entry[:, wrong])
        for language in range(len(self.names)):
            np.add.at(total[language], owner, ended[language])
        filled = np.flatnonzero(sizes)
        total[:, filled] += state[:, np.cumsum(sizes)[filled] - 1] != self.roots[:, None]
        return total, letters

    def judge(self, texts: list[str]) -> list[tuple[str, float]]:
        total, letters = self.count(texts)
        out = []
        for k in range(len(texts)):
            if not letters[k] or not self.names:
                out.append((UNDETERMINED, 0.0))
                continue
            order = np.argsort(total[:, k], kind="stable")
            best = int(order[0])
            if len(order) == 1:
                score = 1.0
            else:
                second = int(total[order[1], k])
                score = (second - int(total[best, k])) / second
            out.append((self.names[best], float(score)))
        return out


def parser_of(samples: tuple, cells: int) -> Parser:
    """The parser of this process, built from the sampled texts."""
    return held(("parser", samples, cells), lambda: Parser({name: list(texts) for name, texts in samples}, cells))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", excerpts: int = EXCERPTS,
        letters: int = LETTERS) -> Parser:
    """A parser of the languages in `lang`, from at most `excerpts` * `letters` letters for each.

    A hash below a threshold draws some eight times as many different texts as
    are kept, whatever the size of the language; only their excerpts are shuffled.
    """
    bounded_batches(docs.sparkSession)
    wanted = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("place"))
    sizes = wanted.groupBy("lang").agg(F.approx_count_distinct("place").alias("n")).collect()  # one row for each language
    bounds = [F.lit(cell) for row in sizes if row["n"] > 8 * excerpts
              for cell in (row["lang"], int((8 * excerpts / row["n"] - 0.5) * 2.0 ** 64))]
    if bounds:  # `first` in the order of the hash, so what lies beyond the threshold would not be kept anyway
        bound = F.create_map(*bounds)[F.col("lang")]
        wanted = wanted.where(bound.isNull() | (F.col("place") <= bound))

    def cut(piece):
        out: list[list] = [[], [], []]
        for name, place, value in zip(piece["lang"].to_pylist(), piece["place"].to_pylist(), piece["text"].to_pylist()):
            if any(map(str.isalpha, value)):
                middle = max(0, (len(value) - letters) // 2)
                for column, cell in zip(out, (name, place, value[middle:middle + letters])):
                    column.append(cell)
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
            ["lang", "place", "part"])

    parts = map_rows(wanted, cut, "text", "lang string, place long, part string")
    parts = parts.groupBy("lang", "place").agg(F.min("part").alias("part"))  # copies count once
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "part"))
    rows = parts.withColumn("nr", first).where(F.col("nr") <= excerpts).orderBy("lang", "nr").collect()
    samples: dict[str, list[str]] = {}
    for row in rows:  # at most `excerpts` for each language
        samples.setdefault(row["lang"], []).append(row["part"])
    return Parser(samples)


def identified(docs: DataFrame, parser: Parser, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score, in place of columns of these names (in any case); only the text is looked at."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts):
        import pandas as pd

        out: list[tuple[str, float]] = []
        group: list[str] = []
        held = 0
        for value in texts:
            group.append(value or "")
            held += len(group[-1])
            if held > 1 << 21:
                out += parser.judge(group)
                group, held = [], 0
        return pd.DataFrame(out + parser.judge(group), columns=["lang_pred", "score"])

    verdict = free_name(docs, "judged")
    judged = docs.withColumn(verdict, judge(F.col(text)))
    return judged.select(
        *all_but(docs, "lang_pred", "score"), quoted(verdict)["lang_pred"].alias("lang_pred"),
        quoted(verdict)["score"].alias("score"))


def remainder(key: str, parts: int = 4) -> Column:
    """crc32 of the id's text, modulo `parts`; NULL for a NULL id."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))
