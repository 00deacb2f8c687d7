"""Operator 3: secret scans by fixed patterns and by character Markov models.

Three fixed patterns give the base spans. Further tokens are scored by two first-order Markov models over
characters, one of random strings and one of ordinary identifiers: a token is a secret if the log-likelihood
ratio passes a bound. Both are trained from labelled samples that the table itself gives: what the fixed
patterns find counts as random, in its own case and in upper case; other tokens count as ordinary if letters and digits
meet in them once at most (words, names, numbers), and are left out of training if they meet more often. Only DataFrame
functions run here; one pass over the rows, without a shuffle (training adds a pass over a bounded sample).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staveframe.llm._batches import hashed

# The base patterns, in the order in which spans with equal start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 characters or more
HEX = r"[0-9a-f]{32,}"  # [0-9a-f]+ of 32 characters or more
KINDS = ("assign", "access", "hex", "markov")
#: What the models score: runs of the characters that keys are written with.
CANDIDATE = r"[A-Za-z0-9+/_=-]{8,}"
#: Where a letter meets a digit; ordinary tokens have one such place at most.
MEETS = r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
K = len(ALPHABET) + 1
SPAN = "struct<start:bigint,kind:int,end:bigint>"
#: Training rows at most, and the weight of the even prior in either model, in transitions from each character.
FIT_ROWS, PRIOR = 20_000, 20.0
#: A token is a secret from so many nats in all, and on average of each transition.
LEAST_SUM, LEAST_MEAN = 15.0, 0.6


def spans(text: Column, pattern: str, kind: int, keep: Column) -> Column:
    """Spans of the matches of which ``keep`` holds (an array of booleans, one for each match); code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["keep"], F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

    zipped = F.transform(F.arrays_zip(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(1))).alias("gap"), found.alias("hit"), keep.alias("keep")), lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), x["keep"].alias("keep")))
    return F.when(F.exists(keep, lambda k: k), F.aggregate(zipped, start, step, lambda s: s["out"])).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """All base spans ``struct(start, kind, end)``, in order of start and kind. Patterns are only tried on texts that
    hold one of their words, or a run of enough characters, which is cheaper to tell."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    whole = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda _: F.lit(True))
    named = F.lower(text)
    may_assign = F.contains(named, F.lit("passw")) | F.contains(named, F.lit("secret")) | F.contains(named, F.lit("token")) | F.contains(named, F.lit("api"))
    none = F.array().cast(f"array<{SPAN}>")
    each = [
        F.when(may_assign, spans(text, ASSIGN, 0, F.transform(values, lambda v: F.length(v) >= 8))).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), spans(text, ACCESS, 1, whole(ACCESS))).otherwise(none),
        F.when(text.rlike(HEX), spans(text, HEX, 2, whole(HEX))).otherwise(none),
    ]
    return F.array_sort(F.concat(*each))


def train(docs: DataFrame, fit_rows: int = FIT_ROWS, text_col: str = "text") -> list[float]:
    """Log-likelihood ratio of each transition, random against ordinary, row by row of the alphabet (index 0: other).

    Fitted on about ``fit_rows`` rows drawn by a hash of all their columns; all rows where there are fewer. With no
    labelled strings of a kind, the even prior stands for it, which is what random strings are like.
    """
    n = docs.count()
    drawn = docs.where(F.pmod(F.xxhash64(*hashed(docs)), F.lit(1 << 20)) < int((1 << 20) * fit_rows / n)) if n > fit_rows else docs
    texts = drawn.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    secret = F.concat(F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 8), F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))
    both = texts.select(secret.alias("secret"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("token"))
    random = both.select(F.lit(True).alias("random"), F.explode("secret").alias("found")).select("random", F.explode(F.array("found", F.upper("found"))).alias("word"))
    # Tokens that hold a secret aren't ordinary ones.
    ordinary = both.select(F.lit(False).alias("random"), F.explode(F.filter("token", lambda t: ~F.exists("secret", lambda s: F.contains(t, s) | F.contains(s, t)))).alias("word"))
    ordinary = ordinary.where(F.regexp_count("word", F.lit(MEETS)) <= 1)
    words = random.unionByName(ordinary)
    codes = F.transform(F.split("word", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    steps = words.select("random", codes.alias("c")).select("random", F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c")).alias("b"))).alias("x"))
    counted = steps.groupBy("random", (F.col("x.a") * K + F.col("x.b")).alias("step")).count().collect()  # at most 2 x K x K rows
    counts = {kind: [PRIOR / K] * (K * K) for kind in (True, False)}
    for row in counted:
        counts[row["random"]][row["step"]] += row["count"]

    totals = {kind: [sum(c[i * K : i * K + K]) for i in range(K)] for kind, c in counts.items()}
    return [math.log(counts[True][i] / totals[True][i // K]) - math.log(counts[False][i] / totals[False][i // K]) for i in range(K * K)]


def scan(docs: DataFrame, model: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, base, added`` for every row: the base spans and those that the models add, as arrays of
    ``struct(start, kind, end)`` with kind an index into :data:`KINDS`.

    Null texts count as empty; a text without matches has empty arrays; repeated rows are scanned once each; an
    added span never lies within a base span, but may go beyond one that it meets; other columns are left out.
    """
    model = train(docs, text_col=text_col) if model is None else model
    return _found(docs.select(F.col(id_col).cast("long").alias("carried"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), model).withColumnRenamed("carried", "doc_id")


def _found(rows: DataFrame, model: list[float]) -> DataFrame:
    """``carried, text, base, added`` from ``carried, text``."""
    ratio = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    text = F.col("text")

    def secret(token: Column) -> Column:
        state = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
        total = F.aggregate(
            F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c)),
            state,
            lambda s, c: F.struct(c.alias("last"), (s["sum"] + F.when(s["last"] < 0, F.lit(0.0)).otherwise(F.element_at(ratio, s["last"] * K + c + 1))).alias("sum")),
            lambda s: s["sum"],
        )
        return (total >= LEAST_SUM) & (total >= LEAST_MEAN * (F.length(token) - 1))

    keep = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), secret)
    rows = rows.select("carried", "text", base_spans(text).alias("base"), keep.alias("keep"))
    rows = rows.select("carried", "text", "base", spans(text, CANDIDATE, 3, F.col("keep")).alias("scored"))
    new = lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    return rows.select("carried", "text", "base", F.filter("scored", new).alias("added"))


def listed(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the array's order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame) -> DataFrame:
    """Digest of :func:`scan`: counts of base spans by kind, ``base_sha256`` and all ``spans`` as text."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_markov"),
    )


def redact(docs: DataFrame, model: list[float] | None = None, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with every span of the text replaced by ``mask``; overlapping spans
    become one. Null texts stay null; texts without spans stay as they are."""
    model = train(docs, text_col=text_col) if model is None else model
    rows = _found(docs.select(F.struct("*").alias("carried"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), model)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        ahead = F.concat(state["out"], F.substring(F.col("text"), (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int")), F.lit(mask))
        out = F.when(x["start"] < state["at"], state["out"]).otherwise(ahead)
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), out.alias("out"))

    tail = lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text")))
    every = F.array_sort(F.concat("base", "added"))
    masked = F.when(F.size(every) == 0, F.col(f"carried.{text_col}")).otherwise(F.aggregate(every, start, step, tail))
    return rows.select(*[masked.alias(c) if c == text_col else F.col("carried").getField(c).alias(c) for c in docs.columns])
