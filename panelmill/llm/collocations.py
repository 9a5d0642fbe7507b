"""Phrases whose words stand together more often than their parts suggest: multikey quicksort of word suffixes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.common import mix, slices, sorted_groups
from panelmill.llm.filters import KeyFilter, key_filter
from panelmill.session import cut_lineage

#: Texts of about so many characters are counted together before they are sent.
BLOCK_CHARS = 8_000_000
#: A word or pair with at least this share of a language's words is routed by one word more.
HOT_SHARE = 1024
#: Buckets of suffixes per shuffle partition; a task sorts one bucket at a time.
BUCKETS = 8
# Bytes of texts after folding: 0xff, which no UTF-8 text holds, parts pieces; a blank parts words.
_CUTS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(0xFF if b in _CUTS else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_CUT, _RARE = -1, 0


def words_of(text: str) -> list[bytes]:
    """Lower-cased words in order, with the byte 0xff between pieces."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(b"\xff", b" \xff ").split()


def word_key(lang: bytes, word: bytes, salt: int | None = None) -> int:
    """63-bit key of a word of a language, for filters and routes."""
    return zlib.crc32(word, zlib.crc32(lang + b"\x00") if salt is None else salt) << 31 | zlib.crc32(word) >> 1


class _Lexicon(dict):
    """Local numbers of words from 1 on, the cut's and, with a filter, 0 for words that are surely infrequent."""

    def __init__(self, lang: str, common: KeyFilter | None = None):
        super().__init__({b"\xff": _CUT})
        self.lang, self.common, self.words, self.keys = lang.encode("utf-8", "surrogatepass"), common, [b""], [0]

    def learn(self, words: list[bytes]) -> None:
        """Number the words that are new."""
        fresh = list(set(words).difference(self))
        salt = zlib.crc32(self.lang + b"\x00")
        keys = [word_key(self.lang, word, salt) for word in fresh]
        passed = self.common.passes(np.array(keys, np.int64)).tolist() if self.common is not None else [True] * len(fresh)
        for word, key, known in zip(fresh, keys, passed, strict=True):
            if known:
                self[word] = len(self.words)
                self.words.append(word)
                self.keys.append(key)
            else:
                self[word] = _RARE


def _blocks(batches: Iterator[pa.RecordBatch], common: KeyFilter | None = None) -> Iterator[tuple[str, _Lexicon, np.ndarray]]:
    """(language, lexicon, word numbers of its texts in a row, with cuts between) for every block of texts."""
    lexica: dict[str, _Lexicon] = {}
    codes: dict[str, list[np.ndarray]] = {}
    size = 0

    def done():
        for lang, own in codes.items():
            yield lang, lexica[lang], np.concatenate(own).astype(np.int64)

    for part, texts in slices(batches):
        own: dict[str, list[bytes]] = {}
        for lang, text in zip(part.column(part.schema.get_field_index("lang")).to_pylist(), texts, strict=True):
            words = own.setdefault(lang, [])
            words += words_of(text)
            words.append(b"\xff")
            size += len(text)
        for lang, words in own.items():
            lexicon = lexica.get(lang)
            if lexicon is None:
                lexicon = lexica[lang] = _Lexicon(lang, common)
            lexicon.learn(words)
            codes.setdefault(lang, []).append(np.fromiter(map(lexicon.__getitem__, words), np.int32, len(words)))
        if size >= BLOCK_CHARS:
            yield from done()
            codes, size = {}, 0
            if sum(map(len, lexica.values())) > 600_000:
                lexica = {}
    yield from done()


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    return docs.select(lang.alias("lang"), F.col("text"))


COUNTS = "lang string, word string, next string, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of the task's texts, and the pairs that are frequent within a block."""
    totals: dict[int, list] = {}

    def rows(lang: str, words: list[bytes], following: list[bytes | None], n: np.ndarray) -> pa.RecordBatch:
        text = lambda x: pa.array(x, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), text(words), text(following), pa.array(n, pa.int64())], [c.split()[0] for c in COUNTS.split(", ")])

    def counted(lexicon: _Lexicon, n: np.ndarray) -> pa.RecordBatch:
        own = np.flatnonzero(n)
        return rows(lexicon.lang.decode("utf-8", "surrogatepass"), [lexicon.words[i] for i in own.tolist()], [None] * len(own), n[own])

    for lang, lexicon, codes in _blocks(batches):
        n = np.bincount(codes[codes > 0], minlength=len(lexicon.words))
        held = totals.get(id(lexicon))
        if held is not None:
            n[: len(held[1])] += held[1]
        totals[id(lexicon)] = [lexicon, n]
        pairs = (codes[:-1] << 32 | codes[1:])[(codes[:-1] > 0) & (codes[1:] > 0)]
        pair, count = np.unique(pairs, return_counts=True)
        heavy = count >= max(2, len(codes) // HOT_SHARE)
        if heavy.any():
            first, second = (pair[heavy] >> 32).tolist(), (pair[heavy] & 0xFFFFFFFF).tolist()
            yield rows(lang, [lexicon.words[i] for i in first], [lexicon.words[i] for i in second], count[heavy])
        if len(totals) > 64:
            yield from (counted(*x) for x in totals.values())
            totals = {}
    yield from (counted(*x) for x in totals.values())


SUFFIXES = "bucket int, lang string, deep boolean, words array<binary>, {ids}, n array<long>"


def _gather(depth: int, buckets: int, common, hot: set[int], hot_pairs: set[int]):
    """Distinct word suffixes of every block with their counts, dealt by leading words."""

    def ragged(values: pa.Array, bounds: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "lang", "deep", "words", *[f"w{d}" for d in range(depth)], "n"]
        for lang, lexicon, codes in _blocks(batches, common.value):
            codes = np.concatenate([codes, np.full(depth, _CUT)])
            heads = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
            if not len(heads):
                continue
            # A suffix ends before the first cut or infrequent word; equal ones are counted once. Wide keys are numbered anew on the way.
            key, bits = codes[heads], 21
            ended = np.zeros(len(heads), bool)
            for d in range(1, depth):
                own = codes[heads + d]
                ended |= own <= 0
                if bits + 21 > 63:
                    key, bits = np.unique(key, return_inverse=True)[1], 32
                key, bits = key << 21 | np.where(ended, 0, own), bits + 21
            key, first, n = np.unique(key, return_index=True, return_counts=True)
            at = heads[first]
            ids = np.stack([codes[np.minimum(at + d, len(codes) - 1)] for d in range(depth)])
            ids[1:][np.logical_or.accumulate(ids[1:] <= 0)] = 0
            hashes = np.array(lexicon.keys, np.int64)
            route = hashes[ids[0]].copy()
            pair = mix((hashes[ids[0]] * 31 + hashes[ids[1]]).view(np.uint64)).view(np.int64)
            is_hot = np.isin(route, np.fromiter(hot, np.int64, len(hot)))
            deep = is_hot & np.isin(pair, np.fromiter(hot_pairs, np.int64, len(hot_pairs)))
            route[is_hot] = pair[is_hot]
            if deep.any():
                # A hot pair is routed by its third word; its own count goes ahead as a suffix of two words.
                pairs, where = np.unique(ids[:2, deep], axis=1, return_inverse=True)
                short = np.zeros((depth, pairs.shape[1]), np.int64)
                short[:2] = pairs
                sums = np.bincount(where.ravel(), weights=n[deep], minlength=pairs.shape[1]).astype(np.int64)
                longer = deep & (ids[2] > 0) if depth > 2 else np.zeros(len(n), bool)
                by_third = mix((pair + hashes[ids[min(2, depth - 1)]]).view(np.uint64)).view(np.int64)
                short_route = mix((hashes[short[0]] * 31 + hashes[short[1]]).view(np.uint64)).view(np.int64)
                ids = np.concatenate([ids[:, ~deep], ids[:, longer], short], axis=1)
                route = np.concatenate([route[~deep], by_third[longer], short_route])
                n = np.concatenate([n[~deep], n[longer], sums])
                deep = np.concatenate([np.zeros((~deep).sum(), bool), np.ones(longer.sum(), bool), np.zeros(len(sums), bool)])
            bucket = (mix(route.view(np.uint64)) % np.uint64(buckets)).astype(np.int64) * 2 + deep
            order = np.argsort(bucket, kind="stable")
            bucket, ids, n = bucket[order], ids[:, order], n[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            bounds = np.append(starts, len(bucket))
            chunk = np.repeat(np.arange(len(starts)), np.diff(bounds))
            used, local = np.unique((chunk << 21 | ids).ravel(), return_inverse=True)
            base = np.searchsorted(used >> 21, np.arange(len(starts) + 1))
            local = local.reshape(ids.shape) - base[chunk]
            local[ids == 0] = -1
            words = pa.array(lexicon.words, pa.binary()).take(pa.array(used & (1 << 21) - 1))
            columns = [
                pa.array(bucket[starts] >> 1, pa.int32()), pa.array([lang] * len(starts), pa.string()), pa.array((bucket[starts] & 1).astype(bool)), ragged(words, base),
                *[ragged(pa.array(x, pa.int32()), bounds) for x in local], ragged(pa.array(n, pa.int64()), bounds),
            ]
            out = pa.RecordBatch.from_arrays(columns, names)
            for at in range(0, out.num_rows, 2000):
                yield out.slice(at, 2000)

    return gather


def multikey_counts(keys: list[np.ndarray], weights: np.ndarray, least: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of weighted suffix pointers, all parts of a level at once.

    ``keys[d]``: the word number at depth d, -1 behind the end. Every part is split by the word of a pivot pointer into smaller, equal and
    greater; the weight of an equal part is the count of its words, and it is sorted on by the next word. Parts
    of a weight below ``least`` are abandoned: nothing in them can reach it. Returns (words, a pointer of each part, its count) per equal part.
    """
    pointers = np.flatnonzero(keys[0] >= 0)
    starts = np.array([0] if len(pointers) else [], np.int64)
    depth = np.zeros(len(starts), np.int64)
    flat = np.stack(keys)
    found = []
    while len(starts):
        sizes = np.diff(np.append(starts, len(pointers)))
        part = np.repeat(np.arange(len(starts)), sizes)
        value = flat[depth[part], pointers]
        a, b, c = (value[starts + (sizes - 1) * k // 2] for k in range(3))
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
        side = part * 3 + (value > pivot[part]) + (value >= pivot[part])
        count = np.bincount(side, minlength=3 * len(starts))
        weight = np.bincount(side, weights=weights[pointers], minlength=3 * len(starts)).astype(np.int64)
        pointers = pointers[np.argsort(side, kind="stable")]
        first = np.cumsum(count) - count
        which = np.arange(3 * len(starts))
        equal, deeper = which % 3 == 1, np.repeat(depth, 3)
        real = equal & (weight >= least) & (np.repeat(pivot, 3) >= 0)
        for d in np.unique(deeper[real]).tolist():
            own = real & (deeper == d)
            found.append((d + 1, pointers[first[own]], weight[own]))
        deeper = deeper + equal
        keep = (weight >= least) & (count > 0) & (~equal | real) & (deeper < len(keys))
        pointers = pointers[np.repeat(keep, count)]
        depth = deeper[keep]
        count = count[keep]
        starts = np.cumsum(count) - count
    return found


def _sort(depth: int, least: int):
    """Counts of all phrases of two words and more in the buckets that reach the task."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["bucket", "lang"]):
            group = group.combine_chunks()
            column = lambda name: group.column(name).combine_chunks()
            lists, lang = column("words"), group.column("lang")[0].as_py()
            coded = lists.flatten().dictionary_encode()
            number, lexicon = coded.indices.to_numpy(), coded.dictionary
            rows = np.diff(column("n").offsets.to_numpy())
            base = np.repeat((lists.offsets.to_numpy() - lists.offsets[0].as_py())[:-1], rows)
            keys = []
            for d in range(depth):
                local = column(f"w{d}").flatten().to_numpy()
                keys.append(np.where(local < 0, -1, number[np.where(local < 0, 0, local + base)]))
            n = column("n").flatten().to_numpy()
            deep = np.repeat(column("deep").to_numpy(zero_copy_only=False), rows)
            # Suffixes of a hot pair count from the third word on: before it their pair has been counted as a whole, in another bucket.
            for own, shortest in ((~deep, 2), (deep, 3)):
                for words, pointer, count in multikey_counts([k[own] for k in keys], n[own], least) if own.any() else []:
                    if words < shortest:
                        continue
                    parts = [lexicon.take(pa.array(k[own][pointer])) for k in keys[:words]]
                    phrase = [b" ".join(x) for x in zip(*(p.to_pylist() for p in parts), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(phrase), pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array([words] * len(phrase), pa.int32()), pa.array(count, pa.int64())],
                        ["lang", "phrase", "words", "a"],
                    )

    return sort


def phrase_counts(docs: DataFrame, least: int = 10, longest: int = 3) -> tuple[DataFrame, DataFrame]:
    """(totals, phrases): ``lang``, ``n`` words; and ``lang``, ``phrase``, ``words``, ``a``: all phrases of 1 to ``longest`` words with at least ``least`` occurrences.

    A first pass counts words and finds those (and the pairs) that make up a large share of a language: at most ``HOT_SHARE`` of either per language, so the driver
    holds a bounded number. The second pass numbers the words, drops those that are infrequent for sure, counts equal
    suffixes per block and sends them by leading word; suffixes of hot words go by two words, those of hot pairs by three. Tasks sort a bucket at a time.
    """
    spark, texts = docs.sparkSession, _texts(docs)
    counted = texts.mapInArrow(_count, COUNTS).groupBy("lang", "word", "next").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)
    single = counted.where("next is null").select("lang", "word", "n")
    totals = cut_lineage(single.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = cut_lineage(single.where(F.col("n") >= least))
    shares = counted.join(totals.select("lang", F.col("n").alias("_all")), "lang").where(F.col("n") * HOT_SHARE >= F.greatest(F.col("_all"), F.lit(least * HOT_SHARE)))
    hot, hot_pairs = set(), set()
    for r in shares.select("lang", "word", "next").toLocalIterator():
        lang = r["lang"].encode("utf-8", "surrogatepass")
        key = word_key(lang, r["word"].encode("utf-8", "surrogatepass"))
        if r["next"] is None:
            hot.add(key)
        else:
            second = word_key(lang, r["next"].encode("utf-8", "surrogatepass"))
            with np.errstate(over="ignore"):
                hot_pairs.add(int(mix((np.array([key], np.int64) * 31 + np.array([second], np.int64)).view(np.uint64)).view(np.int64)[0]))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_key(a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["key"])

    common = spark.sparkContext.broadcast(key_filter(frequent.select("lang", "word").mapInArrow(keys, "key long")))
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = SUFFIXES.format(ids=", ".join(f"w{d} array<int>" for d in range(longest)))
    routed = texts.mapInArrow(_gather(longest, buckets, common, hot, hot_pairs), schema).repartition("bucket").sortWithinPartitions("bucket", "lang")
    phrases = cut_lineage(routed.mapInArrow(_sort(longest, least), "lang string, phrase string, words int, a long"))
    return totals, phrases.unionByName(frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("a")))


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    ``docs``: text and, if present, lang (NULL: ``und``); other columns are ignored, repeated rows count again, NULL and empty texts hold no words, an empty
    table gives no rows. A phrase scores the least of floor(1,000,000 a² / (l r)) over its cuts in two (ties: the first cut). It is dropped if a longer
    candidate holds its words and has at least ``share`` percent of its count. All products are decimals of 38 digits: exact for counts up to 5 * 10**15.
    """
    totals, phrases = phrase_counts(docs, least, longest)
    candidates = phrases.where("words > 1").withColumn("parts", F.split("phrase", " "))
    piece = lambda start, length: F.array_join(F.slice("parts", start, length), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    known = phrases.select("lang", "phrase", "a")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    exact = "cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0)) as decimal(38,0)) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"
    scored = cuts.withColumn("score", F.expr(exact).cast("long")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = candidates.where("words > 2").withColumn("length", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("length") + 1)))
    longer = inner.select("lang", piece(F.col("start"), F.col("length")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * share))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = ranked.join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
grams AS (
  SELECT lang, k AS words, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM starts, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)
), f AS (SELECT lang, words, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS parts FROM f WHERE words > 1 AND a >= 10),
cuts AS (
  SELECT lang, phrase, a, words, k, array_to_string(parts[1 : k], ' ') AS lp, array_to_string(parts[k + 1 :], ' ') AS rp
  FROM candidates, (SELECT unnest([1, 2]) AS k) WHERE k < words
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(parts[1 : 2], ' ') AS phrase, a FROM candidates WHERE words = 3
    UNION ALL SELECT lang, array_to_string(parts[2 : 3], ' '), a FROM candidates WHERE words = 3
  ) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, b.a DESC, phrase) AS rank, phrase, b.a, l, r, n, score::BIGINT AS score
FROM best b JOIN totals USING (lang) LEFT JOIN longer g USING (lang, phrase)
WHERE g.a IS NULL OR 100 * g.a < 50 * b.a
QUALIFY rank <= 2000
"""
