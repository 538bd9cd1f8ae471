"""Phrase collocations by generalised suffix automata.

1. Pieces of texts are packed into blocks, each of one language, and written
   once, in buckets: as numbers into the block's list of words.
2. Three rounds tell each block which of its words, pairs and triples are
   frequent. A block sends 40-bit names of its own distinct ones with their
   counts, some 3 bytes each, and gets a bit for each. Only pairs of frequent
   words are named, and only triples of frequent pairs. (Two of one name only
   mean that more is kept than need be.)
3. Each block cuts its pieces where a pair isn't frequent, and at the middle
   word of a triple that isn't; no frequent phrase is cut by that. It builds a
   generalised suffix automaton over the distinct runs that are left, with the
   number of occurrences as size of each state's endpos set, and lists the
   substrings of 2 to 5 words with their counts. A substring that isn't the
   longest of its state always follows the same word: the suffix links, which
   give each state's shortest string, tell that; a state with one transition to
   a state of its own count is always followed by the same word.
4. Parts of the phrases sum the counts of all blocks. A phrase lies inside a longer one with
   its own count exactly if all blocks name the same word before it, or after.
5. Frequent parts give scores, and each language's best phrases are ranked.

Everything between stages is dealt by phrase or word and summed before it
moves; a language may have all rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, durable, durable_by, shuffle_width
from .heavy import dealt, heavy_hashes

MIN_WORDS, MAX_WORDS = 2, 5
MIN_COUNT, TOP = 100, 2000
#: Text in a block, and text of all open blocks of a task.
BLOCK_BYTES, OPEN_BYTES = 8 << 20, 48 << 20
#: Names of words, pairs and triples, and names that are counted together.
NAME_BITS, PART_NAMES = 40, 1 << 22
#: Words of distinct runs in one automaton (a single run may be longer).
AUTOMATON_WORDS = 1 << 17
#: Parts that a language's phrases are ranked in before the last ranking.
RANK_PARTS = 64

_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)


def pieces(text: bytes) -> Iterator[bytes]:
    """Pieces of UTF-8 text that have a word: A-Z lower-cased, words joined by one space."""
    for piece in text.lower().translate(_ENDS).split(b"\n"):
        if words := piece.split():  # of white space, only space and tab are left
            yield b" ".join(words)


class Automaton:
    """A generalised suffix automaton over sequences of numbers with weights; state 0 is the start."""

    def __init__(self) -> None:
        self.words: list[int] = []  # all sequences, one after another
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link, self.count, self.end = [0], [-1], [0], [0]

    def add(self, sequence: tuple[int, ...], weight: int) -> None:
        at = 0
        for word in sequence:
            at = self._extended(at, word)
            self.count[at] += weight
            self.words.append(word)

    def _state(self, length: int, link: int, moves: dict[int, int], end: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        self.next.append(moves)
        self.end.append(end)
        return len(self.length) - 1

    def _split(self, state: int, old: int, word: int) -> int:
        """The state for what `word` makes of the strings of `state`, which so far share `old` with longer ones."""
        new = self._state(self.length[state] + 1, self.link[old], dict(self.next[old]), self.end[old])
        self.link[old] = new
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]
        return new

    def _extended(self, state: int, word: int) -> int:
        old = self.next[state].get(word)
        if old is not None:
            return old if self.length[old] == self.length[state] + 1 else self._split(state, old, word)
        new = self._state(self.length[state] + 1, 0, {}, len(self.words) + 1)
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            old = self.next[state][word]
            self.link[new] = old if self.length[old] == self.length[state] + 1 else self._split(state, old, word)
        return new

    def substrings(self, least: int, most: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """(substring, occurrences, the word always before it, the word always after it) of every substring of least to most words; 0 where there is no such word, or the substring has `most` words."""
        length, link, count = self.length, self.link, self.count
        for state in np.argsort(np.array(length), kind="stable")[:0:-1].tolist():
            count[link[state]] += count[state]
        for state in range(1, len(length)):
            shortest = length[link[state]] + 1
            if shortest > most:
                continue
            after = 0
            if len(self.next[state]) == 1:
                (word, target), = self.next[state].items()
                after = word if count[target] == count[state] else 0
            end = self.end[state]
            for n in range(max(shortest, least), min(length[state], most) + 1):
                before = self.words[end - n - 1] if n < length[state] else 0
                yield tuple(self.words[end - n : end]), count[state], *((before, after) if n < most else (0, 0))


def _shut(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _open(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _numbered(held: list[bytes]) -> bytes:
    """Pieces as their distinct words, from 1, and numbers, 0 after each piece."""
    numbers: dict[bytes, int] = {b"\n": 0}
    ids = np.array([numbers.setdefault(w, len(numbers)) for piece in held for w in (*piece.split(b" "), b"\n")], "<i4")
    words = b"\n".join(list(numbers)[1:])
    return _shut(len(words).to_bytes(8, "little"), words, ids.tobytes())


def _block_batches(block_bytes: int):
    """Packs pieces into blocks of one language. A piece is never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_blocks: dict[str, list] = {}  # language: [bytes, words, pieces]

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal number
            _, words, held = open_blocks.pop(lang)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([lang]), pa.array([words], pa.int64()), pa.array([_numbered(held)], pa.binary())], ["block", "lang", "words", "body"])

        total = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for piece in pieces(text.as_py()):
                    block = open_blocks.setdefault(lang, [0, 0, []])
                    block[0] += len(piece) + 1
                    block[1] += piece.count(b" ") + 1
                    block[2].append(piece)
                    total += len(piece) + 1
                    if block[0] >= block_bytes:
                        total -= block[0]
                        yield closed(lang)
                while total > OPEN_BYTES:
                    largest = max(open_blocks, key=lambda x: open_blocks[x][0])
                    total -= open_blocks[largest][0]
                    yield closed(largest)
        for lang in list(open_blocks):
            yield closed(lang)

    return run


class _Block:
    """The pieces of one block, and what replies have said about its words, pairs and triples so far."""

    def __init__(self, table: pa.Table, replies: pa.Table | None = None) -> None:
        self.number, self.lang = table.column("block")[0].as_py(), table.column("lang")[0].as_py()
        body = _open(table.column("body")[0].as_py())
        size = int.from_bytes(body[:8], "little")
        self.words = [b"", *body[8 : 8 + size].split(b"\n")]
        self.ids = np.frombuffer(body, "<i4", offset=8 + size).astype(np.int64)
        seed = xxhash.xxh64_intdigest(self.lang)
        self.names = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], np.uint64)
        self._flags: dict[int, list[tuple[int, np.ndarray]]] = {}
        self._known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if replies is not None:
            columns = (replies.column(c).to_pylist() for c in ("round", "part", "n", "flags"))
            for gram, part, n, flags in zip(*columns, strict=True):
                self._flags.setdefault(gram, []).append((part, np.unpackbits(np.frombuffer(flags, np.uint8), count=n).astype(bool)))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, names) of all that begin a gram of n words whose shorter grams are all frequent."""
        if n not in self._known:
            at = np.flatnonzero(self.ids > 0)
            if n > 1:
                at = self.frequent(n - 1)
                at = at[:-1][np.diff(at) == 1]  # a shorter gram there and at the next place
            name = self.names[self.ids[at]]
            for i in range(1, n):
                name = name * np.uint64(0x9E3779B97F4A7C15) + self.names[self.ids[at + i]]
            name = (name ^ name >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            self._known[n] = at, name >> np.uint64(64 - NAME_BITS)
        return self._known[n]

    def frequent(self, n: int) -> np.ndarray:
        """The places of grams(n) that all blocks together have often enough, as replies say."""
        at, names = self.grams(n)
        place = np.unique(names, return_inverse=True)[1]
        flags = [f for _, f in sorted(self._flags.get(n, ()), key=lambda x: x[0])]
        return at[np.concatenate(flags)[place]] if flags else at[:0]


def _planes(numbers: np.ndarray) -> bytes:
    """Bytes of equal weight together, as they compress."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


_ASKED = "part int, block long, n int, names binary"
_REPLIES = "block long, part int, round int, n int, flags binary"


def _ask(gram: int, parts: int, enough: int):
    """The block's distinct names for each part, sorted, as steps, with their counts (as far as they matter)."""

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("names", pa.binary())])
        if not blocks.num_rows:
            return schema.empty_table()
        names, counts = np.unique(_Block(blocks, replies).grams(gram)[1], return_counts=True)
        if not len(names):
            return schema.empty_table()
        part = (names * np.uint64(parts)) >> np.uint64(NAME_BITS)
        found, starts = np.unique(part, return_index=True)
        sent = [_shut(_planes(np.diff(n, prepend=np.uint64(0))), _planes(np.minimum(c, enough))) for n, c in zip(np.split(names, starts[1:]), np.split(counts, starts[1:]), strict=True)]
        sizes = np.diff(np.append(starts, len(names)))
        return pa.Table.from_arrays([pa.array(found.astype(np.int32)), pa.array([blocks.column("block")[0].as_py()] * len(found), pa.int64()), pa.array(sizes.astype(np.int32)), pa.array(sent, pa.binary())], schema=schema)

    return run


def _answer(gram: int, enough: int):
    """For each block that asked, a bit for each of its names: whether all blocks have it often enough."""

    def run(asked: pa.Table) -> pa.Table:
        sizes = asked.column("n").to_numpy()
        opened = [_open(x.as_py()) for x in asked.column("names")]
        names = np.concatenate([np.cumsum(_from_planes(x[: len(x) // 2]), dtype=np.uint64) for x in opened])
        counts = np.concatenate([_from_planes(x[len(x) // 2 :]) for x in opened])
        distinct, place = np.unique(names, return_inverse=True)
        often = np.zeros(len(distinct), np.uint64)
        np.add.at(often, place, counts)
        flags = (often >= enough)[place]
        bits = [np.packbits(f).tobytes() for f in np.split(flags, np.cumsum(sizes)[:-1])]
        rounds = pa.array(np.full(len(sizes), gram, np.int32))
        return pa.table({"block": asked.column("block"), "part": asked.column("part"), "round": rounds, "n": asked.column("n"), "flags": pa.array(bits, pa.binary())})

    return run


_WORDS = "part int, lang string, words binary, counts binary"


def _list_words(parts: int):
    """The block's frequent words with their counts, packed for each part."""

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("counts", pa.binary())])
        if not blocks.num_rows:
            return schema.empty_table()
        block = _Block(blocks, replies)
        found, counts = np.unique(block.ids[block.frequent(1)], return_counts=True)
        part = (block.names[found] % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        numbers, starts = np.unique(part[order], return_index=True)
        picks = np.split(order, starts[1:]) if len(order) else []
        words = [_shut(b"\n".join([block.words[i] for i in found[p].tolist()])) for p in picks]
        sums = [_shut(_planes(counts[p])) for p in picks]
        return pa.Table.from_arrays([pa.array(numbers, pa.int32()), pa.array([block.lang] * len(picks), pa.string()), pa.array(words, pa.binary()), pa.array(sums, pa.binary())], schema=schema)

    return run


def _sum_words(enough: int):
    """The words of one part that all blocks of a language have often enough."""

    def run(table: pa.Table) -> pa.Table:
        sums: Counter = Counter()
        for lang, words, counts in zip(*(table.column(c).to_pylist() for c in ("lang", "words", "counts")), strict=True):
            for word, n in zip(_open(words).split(b"\n"), _from_planes(_open(counts)).tolist(), strict=True):
                sums[lang, word] += n
        kept = [(lang, word.decode(), n) for (lang, word), n in sums.items() if n >= enough]
        columns = list(zip(*kept, strict=True)) or [(), (), ()]
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("lang", "phrase", "a"), columns, (pa.string(), pa.string(), pa.int64()), strict=True)})

    return run


def _runs(block: _Block) -> Counter:
    """Longest runs of words whose every pair and triple is frequent, with how often each stands in the block. Runs that meet in an infrequent triple share its middle word."""
    at = block.frequent(2)
    if not len(at):
        return Counter()
    triples = np.zeros(len(block.ids) + 1, bool)
    triples[block.frequent(3)] = True
    first = np.flatnonzero((np.diff(at, prepend=-2) != 1) | ~triples[at - 1])  # the pair before doesn't lead here
    last = np.append(first[1:], len(at)) - 1
    return Counter(tuple(block.ids[a : b + 2].tolist()) for a, b in zip(at[first].tolist(), at[last].tolist(), strict=True))


_PHRASES = "part int, lang string, phrases binary, counts binary"


def _list_phrases(least: int, most: int, parts: int):
    """The block's phrases with their counts and the words that always stand before and after them, packed for each part."""

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary())])
        if not blocks.num_rows:
            return schema.empty_table()
        block = _Block(blocks, replies)
        words, automaton = block.words, Automaton()
        lines: list[bytes] = []
        counts: list[int] = []
        part: list[int] = []
        seed = xxhash.xxh64_intdigest(block.lang)

        def take() -> None:
            for phrase, count, before, after in automaton.substrings(least, most):
                text = b" ".join([words[w] for w in phrase])
                lines.append(b"\t".join((text, words[before], words[after])))
                counts.append(count)
                part.append(xxhash.xxh64_intdigest(text, seed) % parts)

        for sequence, weight in _runs(block).items():
            if automaton.words and len(automaton.words) + len(sequence) > AUTOMATON_WORDS:
                take()
                automaton = Automaton()
            automaton.add(sequence, weight)
        take()
        order = np.argsort(np.array(part, np.int64), kind="stable")
        numbers, starts = np.unique(np.array(part, np.int32)[order], return_index=True)
        picks = np.split(order, starts[1:]) if len(order) else []
        sent = [_shut(b"\n".join([lines[i] for i in p.tolist()])) for p in picks]
        sums = [_shut(_planes(np.array(counts, np.int64)[p])) for p in picks]
        return pa.Table.from_arrays([pa.array(numbers, pa.int32()), pa.array([block.lang] * len(picks), pa.string()), pa.array(sent, pa.binary()), pa.array(sums, pa.binary())], schema=schema)

    return run


def _sum_phrases(enough: int):
    """The phrases of one part that are frequent, and whether every block names the same word before or after it."""

    def run(table: pa.Table) -> pa.Table:
        sums: dict[tuple[str, bytes], list] = {}
        for lang, phrases, counts in zip(*(table.column(c).to_pylist() for c in ("lang", "phrases", "counts")), strict=True):
            for line, n in zip(_open(phrases).split(b"\n"), _from_planes(_open(counts)).tolist(), strict=True):
                text, before, after = line.split(b"\t")
                found = sums.setdefault((lang, text), [0, before, after])
                found[0] += n
                if before != found[1]:
                    found[1] = b""
                if after != found[2]:
                    found[2] = b""
        kept = [(lang, text.decode(), n, bool(before or after)) for (lang, text), (n, before, after) in sums.items() if n >= enough]
        columns = list(zip(*kept, strict=True)) or [(), (), (), ()]
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("lang", "phrase", "a", "inside"), columns, (pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)})

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, words, phrases): lang, n of each language; lang, phrase, a of frequent words; lang, phrase, a, inside of frequent phrases of 2 to max_words words, inside saying that a longer one has the same count."""
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), as_bytes(F.col(f"`{text_col}`")).alias("text"))
    made = texts.mapInArrow(_block_batches(BLOCK_BYTES), "block long, lang string, words long, body binary")
    blocks = durable_by(made, "phrase-blocks", "block", shuffle_width(docs.sparkSession))
    sizes = durable(blocks.groupBy("lang").agg(F.sum("words").alias("n")), "phrase-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle_width(docs.sparkSession), total // PART_NAMES + 1)
    of_block = blocks.groupBy("block")
    replies = docs.sparkSession.createDataFrame([], _REPLIES)
    for gram in (1, 2, 3):
        asked = of_block.cogroup(replies.groupBy("block")).applyInArrow(_ask(gram, parts, min_count), _ASKED)
        replies = replies.unionByName(durable(asked.groupBy("part").applyInArrow(_answer(gram, min_count), _REPLIES), "phrase-replies"))
    told = of_block.cogroup(replies.groupBy("block"))
    counted = told.applyInArrow(_list_words(parts), _WORDS).groupBy("part")
    words = durable(counted.applyInArrow(_sum_words(min_count), "lang string, phrase string, a long"), "phrase-words")
    listed = told.applyInArrow(_list_phrases(MIN_WORDS, max_words, parts), _PHRASES).groupBy("part")
    phrases = durable(listed.applyInArrow(_sum_phrases(min_count), "lang string, phrase string, a long, inside boolean"), "phrase-phrases")
    return sizes, words, phrases


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """Each language's best phrases of 2 to max_words words: lang, rank (from 1), phrase, a, l, r, n, score.

    A-Z are lower-cased; texts (null: empty) are cut at [.,;:!?] and the
    controls 10 to 13 into pieces, and those at spaces and tabs into words.
    Counts are of one language (null: und): n of all its words, a of the
    phrase's occurrences, overlapping ones too, l and r of the two parts at the
    cut with the lowest score, floor(1000 a n / (l r)); of equal ones, that
    after the fewest words. Phrases with a below min_count, and those inside a
    longer phrase of the same count, are left out. Rows are ranked by score,
    then a, both descending, then phrase in byte order. Repeated rows count
    each time; other columns are not read; no rows or no frequent phrase give
    no rows. A piece is never cut, so it has to fit in a task.
    """
    sizes, words, phrases = phrase_counts(docs, text_col, lang_col, min_count, max_words)
    counts = durable(words.unionByName(phrases.select("lang", "phrase", "a")), "phrase-counts")
    split = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.size(split) - 1)).alias("k")
    cuts = phrases.filter("not inside").select("lang", "phrase", "a", cut)
    parts = split  # of the phrase
    cuts = cuts.select("*", F.concat_ws(" ", F.slice(parts, F.lit(1), F.col("k"))).alias("first"), F.concat_ws(" ", F.slice(parts, F.col("k") + 1, F.size(parts))).alias("rest"))
    for side, count in (("first", "l"), ("rest", "r")):
        cuts = durable(cuts, "phrase-cuts")
        own = counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(count))
        left, right = dealt(cuts, own, ("lang", side), heavy_hashes(cuts, "lang", side), F.xxhash64("phrase", "k"))
        cuts = left.join(right, ["lang", side, "deal"]).drop("deal")
    exact = "cast({} as decimal(38, 0))".format
    score = F.expr(f"cast({exact(1000)} * {exact('a')} * {exact('n')} div ({exact('l')} * {exact('r')}) as long)")
    scored = cuts.join(sizes, "lang").select("lang", "phrase", "a", "n", "l", "r", "k", score.alias("score"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b")).select("lang", "phrase", "b.*")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    in_parts = Window.partitionBy("lang", "part").orderBy(*order)
    heads = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("place", F.row_number().over(in_parts)).filter(F.col("place") <= top)
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
sizes AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
f AS (
  SELECT lang, m, phrase, count(*) AS a
  FROM (SELECT lang, m, array_to_string(w[s:s + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM pieces, range(1, 6) AS t(m)))
  GROUP BY lang, m, phrase HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
covered AS (
  SELECT DISTINCT p.lang, p.phrase FROM c q, range(1, 5) AS t(s), range(2, 5) AS u(m) JOIN c p ON p.phrase = array_to_string(q.w[s:s + u.m - 1], ' ') AND p.lang = q.lang AND p.m = u.m
  WHERE u.m < q.m AND s + u.m - 1 <= q.m AND 100 * q.a >= 100 * p.a),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM c ANTI JOIN covered USING (lang, phrase)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, n, k, CAST((1000::HUGEINT * cuts.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts JOIN sizes USING (lang) JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM best QUALIFY rank <= 2000
"""
