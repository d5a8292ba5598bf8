"""Phrase collocation mining with weighted acyclic automata.

Every word occurrence begins a path of up to four words of its piece of text.  A task
counts the paths of its texts, sorts them and builds count transducers (``automaton``),
one for each prefix range of a language.  The transducers of a range meet, are united
with their weights summed, and the frequency of every phrase of one to four words is
the sum over its prefix range of paths.  Phrases whose paths lie in several ranges add
up their parts.  Frequent phrases are then composed with the transducers of their parts:
each cut of a candidate looks up both parts in the range that holds them.

Prefix ranges come from paths of a sample of texts.  They only decide which task a path
goes to; counts cover every word.  A range is cut anywhere in a path, so a hot first word,
or a hot pair, is spread over many ranges, and copies of a path are one path of a task.

Results for odd input: null and empty texts, and pieces without words, count nothing; a null
``lang`` is ``und`` (as is that lang itself); every row counts, equal ones too; words of any
length count whole; ties of score and count go by phrase in byte order; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltaic.session import materialize

from .automaton import Automaton, place, prefix_sums, sort_paths, union
from .common import row_slices

#: Words of a path, and of the longest phrase.
WORDS = 4
#: Separators of pieces (``.,;:!?`` and \\x0A-\\x0D) become \\n, a tab a blank.
_PIECES = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
#: Fixed value: the language of rows without one.
UNKNOWN = "und"


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def slices(text: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """A long text as (slice, bytes of it that are the slice's own): cut at blanks, and every
    slice goes on for the words that paths begun in its own part reach."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end] not in b" \n":
            end += 1
        more = min(end, len(text))
        for _ in range(WORDS - 1):
            while more < len(text) and text[more] in b" \n":
                more += 1
            while more < len(text) and text[more] not in b" \n":
                more += 1
        yield text[at:more], min(end, len(text)) - at
        at = end


class _Shard:
    """Word numbers of one language's texts and how far a path may go from each."""

    def __init__(self):
        self.vocabulary, self.ids, self.reach, self.size = _Vocabulary(), [], [], 0

    def add(self, text: bytes, own: int | None = None) -> None:
        """Texts, normalised and joined by line ends; only paths begun in the first ``own`` bytes count."""
        pieces = [p.split() for p in text.split(b"\n")]
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(lens.sum())
        if not n:
            return
        ids = np.fromiter(map(self.vocabulary.__getitem__, chain.from_iterable(pieces)), np.int32, n)
        reach = np.minimum(np.repeat(np.cumsum(lens), lens) - np.arange(n), WORDS).astype(np.int8)
        if own is not None and own < len(text):
            reach[len(text[:own].split()):] = 0
        self.ids.append(ids)
        self.reach.append(reach)
        self.size += n

    def paths(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(sorted words, distinct paths in order, their counts)."""
        words = sorted(self.vocabulary)
        rank = np.zeros(len(words) + 1, np.int32)
        rank[[self.vocabulary[w] for w in words]] = np.arange(1, len(words) + 1)
        x = rank[np.concatenate(self.ids + [np.zeros(WORDS, np.int32)])]
        reach = np.concatenate(self.reach)
        n = len(reach)
        cols = [np.where(reach > j, x[j:j + n], 0) for j in range(WORDS)]
        paths, count = sort_paths(np.stack(cols, 1)[reach > 0], len(words))
        return words, paths, count


def _normal(texts: list[bytes | None]) -> bytes:
    return b"\n".join([t for t in texts if t]).lower().translate(_PIECES)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes | None]]]:
    found: dict[str, list] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        found.setdefault(lang, []).append(text)
    yield from found.items()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text"))


def prefix_ranges(rows: DataFrame, range_bytes: int, max_ranges: int, texts: int = 200, paths: int = 32) -> dict[str, list[tuple[bytes, ...]]]:
    """Bounds between the prefix ranges of each language, one range for ``range_bytes`` of
    text (more, if that would be over ``max_ranges``), from evenly spaced paths of about
    ``texts`` different texts or two a range, if more.  Languages of one range have none."""
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("text").alias("n")).where("bytes > 0")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    each = max(range_bytes, total // max_ranges)
    wanted = {r.lang: (-(-r.bytes // each), r.n) for r in sizes.where(F.col("bytes") > each).collect()}
    if not wanted:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for lang, (k, n) in wanted.items() for x in (lang, float(max(texts, 2 * k) / n))]), F.col("lang"))
    h = F.xxhash64("text")
    sample = (rows.where(F.col("lang").isin(list(wanted)) & F.col("text").isNotNull()).withColumn("h", h)
              .where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).groupBy("lang", "h").agg(F.first("text").alias("text")).drop("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 16):
            out = []
            for lang, some in _by_lang(batch):
                for text in some:
                    shard = _Shard()
                    shard.add(_normal([text]))
                    if shard.size:
                        words, found, _ = shard.paths()
                        picked = found[np.unique(np.linspace(0, len(found) - 1, paths).astype(np.int64))]
                        out += [(lang, [words[i - 1] if i else b"" for i in p]) for p in picked.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.binary()))],
                                             ["lang", "path"])
    drawn: dict[str, list] = {}
    for r in sample.mapInArrow(run, "lang string, path array<binary>").collect():
        drawn.setdefault(r.lang, []).append(tuple(bytes(w) for w in r.path))
    out = {}
    for lang, found in drawn.items():
        found.sort()
        k = wanted[lang][0]
        out[lang] = sorted({found[len(found) * i // k] for i in range(1, k)})
    return out


def transducers(rows: DataFrame, ranges, shard_words: int, slice_bytes: int) -> DataFrame:
    """(``lang``, ``range``, ``automaton``): count transducers of each task's texts, by prefix range.
    ``ranges`` is the broadcast of ``prefix_ranges``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, _Shard] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, shard in shards.items():
                words, paths, count = shard.paths()
                cuts = [0, *[place(words, paths, b) for b in ranges.value.get(lang, [])], len(paths)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if b > a:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang], pa.string()), pa.array([k], pa.int32()),
                             pa.array([Automaton.build(words, paths[a:b], count[a:b]).to_bytes()], pa.binary())], ["lang", "range", "automaton"])
            shards.clear()

        for batch in row_slices(batches, 256):
            for lang, texts in _by_lang(batch):
                long = [t for t in texts if t and len(t) > slice_bytes]
                shard = shards.setdefault(lang, _Shard())
                shard.add(_normal([t for t in texts if t and len(t) <= slice_bytes]))
                for text in long:
                    for part, own in slices(_normal([text]), slice_bytes):
                        shard = shards.setdefault(lang, _Shard())
                        shard.add(part, own)
                        if shard.size >= shard_words:
                            yield from flush()
                if not shards.get(lang, shard).size:
                    shards.pop(lang, None)
            if sum(s.size for s in shards.values()) >= shard_words:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "lang string, range int, automaton binary")


def frequencies(rows: DataFrame, ranges, min_count: int, shard_words: int, slice_bytes: int) -> DataFrame:
    """(``lang``, ``range``, ``phrase``, ``n_words``, ``f``): every phrase of up to four words found
    ``min_count`` times, and one row per language of all its words, ``phrase`` null."""
    def unite(key, table):
        lang, k = key[0].as_py(), key[1].as_py()
        bounds = ranges.value.get(lang, [])
        words, paths, weight = union(Automaton.from_bytes(b) for b in table.column("automaton").to_pylist())
        beside = [b for i in (k - 1, k) if 0 <= i < len(bounds) for b in [bounds[i]]]
        out = [(k, None, 0, int(weight.sum()))]
        for size in range(1, WORDS + 1):
            at, sums = prefix_sums(paths, weight, size)
            # a prefix of a bound may have paths in the next range too: its part is kept whatever it is
            torn = [b[:size] for b in beside]
            keep = sums >= min_count
            for b in torn:
                first = place(words, paths, b + (b"",) * (WORDS - size))
                keep |= at == first
            for i, f in zip(at[keep].tolist(), sums[keep].tolist()):
                phrase = tuple(words[w - 1] for w in paths[i, :size].tolist())
                home = k if phrase not in torn else bisect_right(bounds, phrase + (b"",) * (WORDS - size))
                out.append((home, b" ".join(phrase), size, f))
        return pa.table([pa.array([lang] * len(out), pa.string()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()),
                         pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.int64())],
                        names=["lang", "range", "phrase", "n_words", "f"])

    parts = transducers(rows, ranges, shard_words, slice_bytes).groupBy("lang", "range").applyInArrow(
        unite, "lang string, range int, phrase binary, n_words int, f long")
    spread = parts.withColumn("range", F.when(F.col("phrase").isNotNull(), F.col("range")))
    return spread.groupBy("lang", "range", "phrase", "n_words").agg(F.sum("f").alias("f")).where(F.col("phrase").isNull() | (F.col("f") >= min_count))


def part_frequencies(frequent: DataFrame, ranges) -> DataFrame:
    """(``lang``, ``phrase``, ``k``, ``l``, ``r``): for each frequent phrase and cut after its first k
    words the frequencies of both parts, by composition within the parts' prefix ranges."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 4096):
            out = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, bounds = phrase.split(b" "), ranges.value.get(lang, [])
                for k in range(1, len(words)):
                    for side, part in enumerate((words[:k], words[k:])):
                        home = bisect_right(bounds, tuple(part) + (b"",) * (WORDS - len(part)))
                        out.append((lang, home, b" ".join(part), phrase, k, side))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(
                (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()))], ["lang", "range", "part", "phrase", "k", "side"])

    def compose(key, counted, asked):
        found = sorted((tuple(p.split(b" ")), f) for p, f in zip(counted.column("phrase").to_pylist(), counted.column("f").to_pylist()))
        words = sorted({w for p, _ in found for w in p})
        index = {w: i + 1 for i, w in enumerate(words)}
        paths = np.array([[index[w] for w in p] + [0] * (WORDS - len(p)) for p, _ in found], np.int32).reshape(-1, WORDS)
        weight = np.array([f for _, f in found], np.int64)
        parts = [tuple(p.split(b" ")) for p in asked.column("part").to_pylist()]
        got = Automaton.build(words, paths, weight).weights_of(parts) if len(found) else np.zeros(len(parts), np.int64)
        return asked.select(["lang", "phrase", "k", "side"]).append_column("f", pa.array(got, pa.int64()))

    asked = frequent.where("n_words > 1").select("lang", "phrase").mapInArrow(cut, "lang string, range int, part binary, phrase binary, k int, side int")
    return (frequent.groupBy("lang", "range").cogroup(asked.groupBy("lang", "range"))
            .applyInArrow(compose, "lang string, phrase binary, k int, side int, f long")
            .groupBy("lang", "phrase", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")))


def collocations(docs: DataFrame, min_count: int = 30, inside_percent: int = 80, top: int = 2000, range_bytes: int = 12 << 20,
                 max_ranges: int = 1 << 17, shard_words: int = 4_000_000, slice_bytes: int = 4 << 20) -> DataFrame:
    """(``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``): each language's first ``top``
    phrases of two to four words found ``min_count`` times, without those inside a longer
    candidate that has ``inside_percent`` of their count."""
    rows = _rows(docs)
    ranges = docs.sparkSession.sparkContext.broadcast(prefix_ranges(rows, range_bytes, max_ranges))
    counted = materialize(frequencies(rows, ranges, min_count, shard_words, slice_bytes), "phrase_counts")
    frequent = counted.where("phrase is not null")
    totals = counted.where("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))

    def exact(c: str):
        return F.col(c).cast("decimal(20,0)")
    cuts = part_frequencies(frequent, ranges).join(frequent.select("lang", "phrase", F.col("f").alias("a")), ["lang", "phrase"])
    score = F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    words = F.split(F.col("phrase").cast("string"), " ", -1)
    spans = [F.array_join(F.slice(F.col("w"), i, m), " ").alias("s") for m in range(2, WORDS) for i in range(1, WORDS - m + 2)]
    ends = [(i + m - 1, m) for m in range(2, WORDS) for i in range(1, WORDS - m + 2)]
    inner = F.filter(F.array(*[F.when((F.col("n_words") >= e) & (F.col("n_words") > m), s) for (e, m), s in zip(ends, spans)]), lambda x: x.isNotNull())
    longer = (frequent.where("n_words > 2").withColumn("w", words).select("lang", F.explode(F.array_distinct(inner)).alias("inside"), F.col("f").alias("outer"))
              .groupBy("lang", "inside").agg(F.max("outer").alias("outer")))
    candidates = lowest.withColumn("phrase", F.col("phrase").cast("string"))
    kept = candidates.join(longer.withColumnRenamed("inside", "phrase"), ["lang", "phrase"], "left").where(
        F.col("outer").isNull() | (exact("outer") * 100 < exact("a") * inside_percent))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    return (kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).join(totals, "lang")
            .select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))


def oracle(min_count: int = 30, inside_percent: int = 80, top: int = 2000) -> str:
    """DuckDB SQL of ``collocations``."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    gram = "array_to_string(list_slice(ws, i, i + m - 1), ' ')"
    return f"""
with t as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), {letters}), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
p as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from t),
g as (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from p, (values (1), (2), (3), (4)) v(m) where len(ws) >= m),
f as (select lang, m, {gram} as phrase, count(*) as f from g group by 1, 2, 3),
total as (select lang, sum(len(ws)) as n from p group by 1),
c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as ws from f where m > 1 and f >= {min_count}),
k as (select *, unnest(range(1, m)) as k from c),
s as (select k.lang, k.phrase, k.a, k.k, x.f as l, y.f as r, (k.a::hugeint * 2000000) // (x.f + y.f) as score
  from k join f x on x.lang = k.lang and x.phrase = array_to_string(list_slice(k.ws, 1, k.k), ' ')
  join f y on y.lang = k.lang and y.phrase = array_to_string(list_slice(k.ws, k.k + 1, k.m), ' ')),
b as (select *, row_number() over (partition by lang, phrase order by score, k) as o from s),
spans as (select lang, a, ws, m, unnest(range(1, m + 1)) as i from c where m > 2),
inside as (select lang, a, ws, m, i, unnest(range(i + 1, m + 1)) as j from spans),
longer as (select lang, array_to_string(list_slice(ws, i, j), ' ') as phrase, max(a) as outer_f from inside where j - i + 1 < m group by 1, 2),
kept as (select b.* from b left join longer x on x.lang = b.lang and x.phrase = b.phrase
  where b.o = 1 and (x.outer_f is null or 100 * x.outer_f::hugeint < {inside_percent} * b.a::hugeint)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select r.lang, cast(rank as bigint) as rank, phrase, a, l, r.r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked r join total t on t.lang = r.lang where rank <= {top}"""
