"""Three ways of reading a chord label, each a struct of columns; they differ on purpose.

==================  ======================  ==================  ======================
case                strict                  lenient             annotated
==================  ======================  ==================  ======================
unknown text        null (``ok`` false)     no chord (``N``)    unknown (``X``)
``X`` or ``?``      null (``ok`` false)     no chord (``N``)    unknown (``X``)
black keys          sharps                  C#, Eb, F#, Ab, Bb  sharps
minor chord of A    ``Am``                  ``Am``              ``A:min``
bass                kept, transposed        left out            kept beside the label
==================  ======================  ==================  ======================
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pitch classes of letters, spellings, and qualities by what may be written for them.
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
SHARPS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
MIXED = ("C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")
QUALITIES = {
    "maj": ("", "maj", "M", "major"), "min": ("m", "min", "-", "minor"), "7": ("7", "dom7"), "maj7": ("maj7", "M7"), "min7": ("m7", "min7", "-7"),
    "sus2": ("sus2",), "sus4": ("sus4", "sus"), "dim": ("dim", "°", "dim7", "hdim7"), "aug": ("aug", "+"), "add9": ("add9",), "6": ("6", "maj6"), "min6": ("m6", "min6"), "5": ("5",),
}
SUFFIX = {"maj": "", "min": "m", "7": "7", "maj7": "maj7", "min7": "m7", "sus2": "sus2", "sus4": "sus4", "dim": "dim", "aug": "aug", "add9": "add9", "6": "6", "min6": "m6", "5": "5"}
MINOR_LIKE = ("min", "min7", "min6", "dim")
CHORD = r"^([A-G])([#b♯♭]?):?([^/:()]*)(?:\([^)]*\))?(?:/([A-G][#b♯♭]?|[#b]?[0-9]+))?$"
MANUAL = r"^[A-G](?:#|b)?(?:maj7|m7|sus2|sus4|add9|dim|aug|m|7)?$"


def _lookup(values: dict[str, object], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def pitch_class(letter: Column, accidental: Column) -> Column:
    """0 to 11 of a letter and its accidental."""
    shift = F.when(accidental.isin("#", "♯"), 1).when(accidental.isin("b", "♭"), -1).otherwise(0)
    return F.pmod(_lookup(LETTERS, letter) + shift, F.lit(12))


def spelled(pitch: Column, names=SHARPS) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(pitch, F.lit(12)) + 1).cast("int"))


def _parts(label: Column) -> tuple[Column, Column, Column, Column]:
    text = F.trim(label)
    get = lambda k: F.regexp_extract(text, CHORD, k)
    known = {written: quality for quality, forms in QUALITIES.items() for written in forms}
    letter = F.when(get(1) != "", get(1))
    root = F.when(letter.isNotNull(), pitch_class(letter, get(2)))
    bass = F.when(get(4).rlike("^[A-G]"), pitch_class(F.substring(get(4), 1, 1), F.substring(get(4), 2, 1)))
    return root, _lookup(known, get(3)), get(3), bass


def _none(label: Column) -> Column:
    return F.coalesce(F.trim(label).isin("", "N", "NC", "N.C.", "no chord"), F.lit(True))


def strict(label: Column, capo: int = 0) -> Column:
    """``struct(ok, symbol, root, quality, bass)``; a chord that can't be read has ``ok`` false and the rest null."""
    root, quality, _, bass = _parts(label)
    none, ok = _none(label), root.isNotNull() & quality.isNotNull()
    moved, low = F.pmod(root + capo, F.lit(12)), F.pmod(bass + capo, F.lit(12))
    symbol = F.concat(spelled(moved), _lookup(SUFFIX, quality), F.when(low.isNotNull() & (low != moved), F.concat(F.lit("/"), spelled(low))).otherwise(""))
    return F.struct((none | ok).alias("ok"), F.when(none, "N").when(ok, symbol).alias("symbol"), F.when(~none & ok, moved).alias("root"), F.when(~none & ok, quality).alias("quality"), F.when(~none & ok, low).alias("bass"))


def strict_once(label: Column, unknown: str = "N") -> Column:
    """:func:`strict` as one value, which Spark works out once however many of its fields are used; what can't be read
    counts as ``unknown``."""
    return F.transform(F.array(label), lambda x: strict(F.coalesce(x, F.lit(unknown))))[0]


def lenient(label: Column) -> Column:
    """``struct(symbol, root, family)``; what can't be read is no chord, and the bass is left out."""
    root, quality, _, _ = _parts(label)
    ok = ~_none(label) & root.isNotNull() & quality.isNotNull()
    return F.struct(F.when(ok, F.concat(spelled(root, MIXED), _lookup(SUFFIX, quality))).otherwise("N").alias("symbol"), F.when(ok, root).alias("root"), F.when(ok, F.when(quality.isin(*MINOR_LIKE), "min").otherwise("maj")).otherwise("N").alias("family"))


def annotated(label: Column) -> Column:
    """``struct(root, bass, is_none, is_unknown, family, majmin, detailed)``; an unknown quality counts as plain major
    or, if it begins with m but not with maj, minor."""
    root, quality, written, bass = _parts(label)
    none = _none(label)
    unknown = ~none & root.isNull()
    minor = F.coalesce(quality.isin(*MINOR_LIKE), written.rlike("^m(?!aj)"))
    family = F.when(none, "N").when(unknown, "X").when(minor, "min").otherwise("maj")
    plain = F.coalesce(quality, F.when(minor, "min").otherwise("maj"))
    named = lambda q: F.when(none, "N").when(unknown, "X").otherwise(F.concat(spelled(root), F.lit(":"), q))
    return F.struct(F.when(~none, root).alias("root"), F.when(~none, bass).alias("bass"), none.alias("is_none"), unknown.alias("is_unknown"), family.alias("family"), named(family).alias("majmin"), named(plain).alias("detailed"))


def transposed(label: Column, semitones: int) -> Column:
    """The strict symbol moved by so many semitones; null if it can't be read."""
    return strict(label, semitones)["symbol"]


def manual(label: Column) -> Column:
    """A label as a user may type it, with plain accidentals; null unless it is no chord or one of few plain forms."""
    text = F.replace(F.replace(F.trim(label), F.lit("♯"), F.lit("#")), F.lit("♭"), F.lit("b"))
    return F.when(F.upper(text) == "N", "N").when(text.rlike(MANUAL), text)


def annotated_moved(label: Column, semitones: Column) -> Column:
    """The annotated label with its quality and bass, moved by so many semitones; ``N`` and ``X`` stay."""
    c = annotated(label)
    bass = F.when(c["bass"].isNotNull(), F.concat(F.lit("/"), spelled(c["bass"] + semitones))).otherwise("")
    return F.when(c["is_none"], "N").when(c["is_unknown"], "X").otherwise(F.concat(spelled(c["root"] + semitones), F.lit(":"), F.substring_index(c["detailed"], ":", -1), bass))
