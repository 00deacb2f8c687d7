"""Scalar and array functions as Spark columns (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the pitch classes, and the open strings of a guitar from the lowest.
NOTE_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
STANDARD_TUNING = (40, 45, 50, 55, 59, 64)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``x`` held between the bounds; NaN and null give null."""
    return F.when(~F.isnan(x), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def half_up(x: Column, places: int = 4) -> Column:
    """Rounds halves toward plus infinity, at so many places."""
    return F.floor(x * F.lit(10.0**places) + F.lit(0.5)) / F.lit(10.0**places)


def safe_div(a: Column, b: Column) -> Column:
    """``a / b``; 0 where ``b`` is 0 or either is null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confidence(best: Column, margin: Column) -> Column:
    """Confidence of a winner from its score and its lead over the next."""
    return clamp(0.8 * best + 0.2 * clamp(margin / 0.12))


def note_name(midi: Column) -> Column:
    """Name and octave of a MIDI number, such as ``C#4``."""
    names = F.array(*[F.lit(n) for n in NOTE_NAMES])
    return F.concat(F.element_at(names, (F.pmod(midi, F.lit(12)) + 1).cast("int")), (F.floor(midi / 12) - 1).cast("string"))


def fret_positions(midi: Column, most: int = 20, tuning=STANDARD_TUNING, capo: int = 0) -> Column:
    """All ``struct(string, fret)`` on which a MIDI number can be played; string 1 is the highest."""
    every = F.array(*[F.struct(F.lit(len(tuning) - k).alias("string"), (midi - o - capo).cast("int").alias("fret")) for k, o in enumerate(tuning)])
    return F.filter(every, lambda p: (p["fret"] >= 0) & (p["fret"] <= most))


def clock(seconds: Column) -> Column:
    """``m:ss`` of a number of seconds."""
    whole = F.floor(F.greatest(seconds, F.lit(0.0)))
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad(F.pmod(whole, F.lit(60)).cast("string"), 2, "0"))


def byte_size(n: Column) -> Column:
    """A number of bytes as B, KB, MB or GB."""
    unit = lambda k, name: F.concat(F.format_number(n / float(1 << (10 * k)), 1), F.lit(f" {name}"))
    return F.when(n >= 1 << 30, unit(3, "GB")).when(n >= 1 << 20, unit(2, "MB")).when(n >= 1 << 10, unit(1, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def total(xs: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter of two arrays of doubles."""
    n = F.least(F.size(a), F.size(b))
    return total(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter of two arrays; 0 where one has no length."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    return safe_div(dot(x, y), F.sqrt(dot(x, x) * dot(y, y)))


def rms(xs: Column) -> Column:
    """Root of the mean square of an array; 0 for an empty one."""
    return F.sqrt(safe_div(total(F.transform(xs, lambda x: x * x)), F.size(xs)))


def softmax(xs: Column, temperature: float = 1.0) -> Column:
    """Shares of an array of scores."""
    top = F.array_max(xs)
    weights = F.transform(xs, lambda x: F.exp((x - top) / F.lit(temperature)))
    return F.transform(weights, lambda w: w / total(weights))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def entropy(ps: Column, normal: bool = True) -> Column:
    """Entropy of an array of shares in nats; divided by that of the even one if ``normal``."""
    nats = -total(F.transform(ps, lambda p: F.when(p > 0, p * F.ln(p)).otherwise(0.0)))
    return safe_div(nats, F.ln(F.size(ps).cast("double"))) if normal else nats


def argmax(xs: Column) -> Column:
    """Index from 0 of the first largest element."""
    return F.array_position(xs, F.array_max(xs)).cast("int") - 1


def power_scaled(ps: Column, power: float) -> Column:
    """Shares raised to a power and made to add up to 1 again."""
    raised = F.transform(ps, lambda p: F.pow(F.greatest(p, F.lit(0.0)), F.lit(power)))
    return F.transform(raised, lambda p: safe_div(p, total(raised)))


def rolled(xs: Column, by: int) -> Column:
    """An array of twelve pitch classes moved up by so many semitones."""
    k = by % 12
    return xs if k == 0 else F.concat(F.slice(xs, 13 - k, k), F.slice(xs, 1, 12 - k))


def top_two(xs: Column) -> Column:
    """``struct(best, second, index)`` of an array: its two largest elements, and where the first is."""
    by = F.array_sort(F.transform(xs, lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    return F.struct((-by[0]["v"]).alias("best"), (-by[1]["v"]).alias("second"), by[0]["i"].alias("index"))


def strongest_pitch(chroma: Column) -> Column:
    """``struct(pitch_class, confidence)`` of a chroma array; both null or 0 without energy."""
    top = top_two(chroma)
    return F.struct(F.when(top["best"] > 0, top["index"]).alias("pitch_class"), clamp(1.8 * top["best"] + 1.8 * (top["best"] - top["second"])).alias("confidence"))


def hash_share(key: Column, seed: int) -> Column:
    """A number from 0 to 99 from the first 32 bits of the SHA-256 of ``seed:key``."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("long") % 100


def hash_split(key: Column, seed: int) -> Column:
    """development, validation or test in the ratio 70 to 15 to 15."""
    share = hash_share(key, seed)
    return F.when(share < 70, "development").when(share < 85, "validation").otherwise("test")


def canonical_json(entries: Column) -> Column:
    """A flat map as JSON with sorted keys and without null values; numbers are rounded to nine places before."""
    kept = F.map_from_entries(F.array_sort(F.filter(F.map_entries(entries), lambda e: e["value"].isNotNull())))
    return F.to_json(kept)


def title_key(title: Column) -> Column:
    """A title without brackets, signs and doubled blanks, lower-cased."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(title), r"\([^)]*\)|\[[^\]]*\]", " "), r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


#: How counts of an analysis are put into words.
COUNT_TEXTS = {"main": "Final arrangement: %d notes", "raw": "Raw detections: %d", "cleaned": "After cleanup: %d", "chords": "Chord regions: %d"}


def count_texts(counts: dict[str, Column]) -> list[Column]:
    """A column of words for each count; null without the count."""
    return [F.when(n.isNotNull(), F.format_string(COUNT_TEXTS[name], n)).alias(name) for name, n in counts.items()]


def stamp_problem(fields: dict[str, tuple[Column, str]], created: Column) -> Column:
    """Why stored metadata isn't current: the first field that is not the wanted text, or a time of creation that is
    missing or can't be read; null if all is well."""
    out = F.when(F.try_to_timestamp(created).isNull(), "createdAt is missing or invalid")
    for name, (actual, wanted) in reversed(fields.items()):
        out = F.when(~actual.eqNullSafe(F.lit(wanted)), F.concat(F.lit(f"{name} "), F.coalesce(actual, F.lit("missing")), F.lit(f" does not match {wanted}"))).otherwise(out)
    return out


def decimal_sum(x: Column) -> Column:
    """The sum of doubles as ``decimal(28,8)``, each rounded half up as a cast does; exact, so no order of adding bears on it.

    Casting costs more than all else in such a sum. Below 2^40 hundred-millionths a product is off by less than a thousandth,
    so it rounds as its digits do unless it is that near to a half: only what is, or is larger, is cast. The rest is added
    in two words, which no number of rows overflows."""
    units = x * 1e8
    whole = F.floor(units + 0.5)
    plain = (F.abs(units) < float(1 << 40)) & (F.abs(units - whole) < 0.499)
    word = F.when(plain, whole)
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    high, low = zero(F.sum(F.shiftright(word, 20)), "decimal(18,0)"), zero(F.sum(word.bitwiseAND(F.lit((1 << 20) - 1))), "decimal(19,0)")
    added = (high * F.lit(1 << 20).cast("decimal(7,0)") + low) * F.lit("0.00000001").cast("decimal(9,8)")
    return (added + zero(F.sum(F.when(~plain, x.cast("decimal(28,8)"))), "decimal(28,8)")).cast("decimal(28,8)")
