"""Operator 13: how far apart the sources of a language are, by their terms.

Identical texts of a language are collapsed: each task sends a text once, with how often each source has it, and what
comes together under a digest is one text with multiplicities, tokenized once. Its terms are added to its sources,
weighted, so that no copy is ever tokenized or shuffled again. Counts stay sparse: a term that a group lacks has one
and the same value for the whole group, so two groups are compared over the terms they share, over each one's distinct
values against the other's value for absent terms, and by one product for all terms that both lack.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staveframe.llm._batches import chunks, give_back
from staveframe.llm._lineage import cut

#: Documents of a language that a term must be in; the weight added to each count; parts of the whole; terms told a group.
DOCUMENTS, ADDED, WHOLE, TERMS = 30, 5, 1_000_000_000, 50
SALTS = 16
#: Digests and counts that a task remembers before it hands them on.
REMEMBERED, HELD = 400_000, 400_000

#: ASCII letters in lower case, all bytes of other characters as they are, everything else a blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SENT = "lang string, source string, digest binary, text binary, copies long"
COUNTED = "lang string, source string, term string, n long, docs long"


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in their order: runs of letters and of characters beyond ASCII."""
    return text.translate(_LETTERS).split()


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text once, from the first row on that has it; how often each source has it at the end."""
    seen: dict = {}

    def told(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["lang", "source", "digest", "text", "copies"])

    def counts() -> Iterator[pa.RecordBatch]:
        rows = [(lang, source, digest, None, n) for (lang, digest), by in seen.items() for source, n in by.items()]
        for a in range(0, len(rows), 20_000):
            yield told(rows[a : a + 20_000])
        seen.clear()

    kept = 0
    for part in chunks(batches, "text"):
        rows = []
        texts = part.column("text").cast(pa.binary()).to_pylist()
        for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), texts, strict=True):
            lang, source, text = lang or "", source or "", text or b""
            digest = hashlib.blake2b(text, digest_size=16).digest()
            by = seen.get((lang, digest))
            if by is None:
                by = seen[lang, digest] = {}
                rows.append((lang, None, digest, text, None))
            if source not in by:
                kept += 1
            by[source] = by.get(source, 0) + 1
        if rows:
            yield told(rows)
        if kept > REMEMBERED:
            yield from counts()
            kept = 0
    yield from counts()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each text, once, times the copies of each of its sources."""
    held: dict = {}
    size = 0
    owner, text, copies = None, None, {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in held.items():
            words = list(found)
            for a in range(0, len(words), 50_000):
                some = words[a : a + 50_000]
                n, docs = zip(*(found[w] for w in some), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    def done() -> int:
        tf, more = Counter(terms(text)), 0
        for source, times in copies.items():
            found = held.setdefault((owner[0], source), {})
            before = len(found)
            for word, n in tf.items():
                had = found.get(word)
                found[word] = (n * times, times) if had is None else (had[0] + n * times, had[1] + times)
            more += len(found) - before
        return more

    for batch in batches:
        for lang, source, digest, own, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "digest", "text", "copies")), strict=True):
            if (lang, digest) != owner:
                if owner is not None:
                    size += done()
                    if size > HELD:
                        yield from told()
                        size = 0
                owner, text, copies = (lang, digest), own, {}
            if n is not None:
                copies[source] = copies.get(source, 0) + n
    if owner is not None:
        done()
    yield from told()
    give_back()


def _share(count: Column, total: Column) -> Column:
    """1 + floor(WHOLE (count + ADDED) / total) for whole numbers, three digits at a time, so that nothing overflows."""
    value, rest = F.lit(0).cast("long"), count + ADDED
    for k in range(4):
        quotient = F.call_function("div", rest, total)
        value = value * 1000 + quotient
        rest = (rest - quotient * total) * 1000
    return value + 1


def audit(documents: DataFrame, id_cols: tuple = ("lang", "source"), text_col: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has each other source of the language with the summed
    differences of all kept terms' shares, part ``term`` the up to 50 terms of the group that lie most above the language.

    Null text, language and source count as ''. A language keeps the terms that at least 30 of its documents have; where it
    keeps none, all pairs have the value 0 and there are no terms. Repeated rows count as documents of their own. Every
    group that occurs is paired, even without terms; a language of one source has no pair. Ties go to the item that comes
    first in UTF-8. An empty table gives no rows; other columns are left out.
    """
    lang, source = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in id_cols)
    named = documents.select(lang.alias("lang"), source.alias("source"), F.col(f"`{text_col}`").alias("text"))
    sent = named.mapInArrow(_send, SENT)
    together = sent.repartition("lang", "digest").sortWithinPartitions("lang", "digest", F.desc_nulls_last("text"))
    counted = together.mapInArrow(_count, COUNTED)

    # One shuffle by term: group totals, then the language's own by a window over them.
    by_term = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    within = Window.partitionBy("lang", "term")
    kept = by_term.withColumns({"all_docs": F.sum("docs").over(within), "all_n": F.sum("n").over(within)})
    kept = cut(kept.where(F.col("all_docs") >= DOCUMENTS).select("lang", "term", "source", "n", "all_n"))

    languages = kept.select("lang", "term", "all_n").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("total"))
    groups = named.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count("*").alias("terms")), ["lang", "source"], "left")
    groups = groups.join(languages, "lang", "left").select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("terms", F.lit(0)).alias("terms"), "total", (F.coalesce("own", F.lit(0)) + ADDED * F.col("v")).alias("whole"))
    groups = cut(groups.withColumn("absent", F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("whole"))).otherwise(0)))

    shares = kept.join(groups.select("lang", "source", "whole", "v", "total"), ["lang", "source"])
    shares = shares.select("lang", "source", "term", _share(F.col("n"), F.col("whole")).alias("p"), _share(F.col("all_n"), F.col("total") + ADDED * F.col("v")).alias("q"))
    shares = cut(shares)
    return _pairs(shares, groups).unionByName(_terms(shares))


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    within = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(within))
    return out.where(F.col("rank") <= most) if most else out


def _terms(shares: DataFrame) -> DataFrame:
    above = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(above, TERMS)


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """The summed differences of every two groups of a language; as many rows as the report has.

    Of the terms that both have, only sums leave a task. What one has and the other lacks comes from its distinct
    values, which are far fewer than its terms."""
    one, two = groups.alias("one"), groups.alias("two")
    couples = one.join(two, (F.col("one.lang") == F.col("two.lang")) & (F.col("one.source") < F.col("two.source")))
    couples = couples.select(F.col("one.lang").alias("lang"), F.col("one.source").alias("a"), F.col("two.source").alias("b"), F.col("one.absent").alias("a0"), F.col("two.absent").alias("b0"), F.col("one.terms").alias("an"), F.col("two.terms").alias("bn"), F.col("one.v").alias("v"))

    # One language may hold most groups: its values are spread over salts, and each salt meets the few numbers of all groups.
    values = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times")).withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)).cast("int"))
    against = groups.select("lang", F.col("source").alias("other"), F.col("absent").alias("o0"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    alone = values.join(against, ["lang", "salt"]).where("source <> other").groupBy("lang", "source", "other").agg(F.sum(F.abs(F.col("p") - F.col("o0")) * F.col("times")).alias("apart"))

    marked = shares.join(groups.select("lang", "source", "absent"), ["lang", "source"]).select("lang", "term", "source", "p", "absent")
    x, y = marked.alias("x"), marked.alias("y")
    both = x.join(y, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.term") == F.col("y.term")) & (F.col("x.source") < F.col("y.source")))
    gap = F.abs(F.col("x.p") - F.col("y.p")) - F.abs(F.col("x.p") - F.col("y.absent")) - F.abs(F.col("y.p") - F.col("x.absent"))
    both = both.groupBy(F.col("x.lang").alias("lang"), F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(F.sum(gap).alias("shared"), F.count("*").alias("n"))

    left = alone.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), F.col("apart").alias("a_apart"))
    right = alone.select("lang", F.col("source").alias("b"), F.col("other").alias("a"), F.col("apart").alias("b_apart"))
    told = couples.join(both, ["lang", "a", "b"], "left").join(left, ["lang", "a", "b"], "left").join(right, ["lang", "a", "b"], "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    lacking = (F.col("v") - F.col("an") - F.col("bn") + none("n")) * F.abs(F.col("a0") - F.col("b0"))
    told = told.withColumn("value", none("a_apart") + none("b_apart") + none("shared") + lacking)
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return _ranked(told.select("lang", ends.alias("end"), "value").select("lang", "end.source", F.lit("pair").alias("part"), "end.item", "value"))
