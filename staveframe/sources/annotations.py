"""Readers of annotations and the matching writers. All parse inside Spark; malformed rows are skipped or reported as said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staveframe.functions import labels as L
from staveframe.functions.scalars import rolled, safe_div, total

#: Label files of an entry, the best first.
LAB_ORDER = ("majmin.lab", "full.lab", "majmininv.lab")
JAMS = "annotations array<struct<namespace string, data array<struct<time double, duration double, value string, confidence double>>>>, file_metadata struct<title string, artist string, duration double>"
TRACK = "id string, title string, artist string, split string, duration double, audio_path string, feature_path string, beats array<double>, downbeats array<double>, chords array<struct<start double, end double, label string>>, sections array<struct<start double, end double, name string>>, schema_version int"

SECTION = "id: string, status: string, endSeconds: double, normalization: struct<capo: int, soundingKey: string>, normalizedChordSequence: array<string>, manualStartSeconds: array<double>"
SONG = f"artist string, title string, split string, status string, audioPath string, referenceUrl string, sections array<struct<{SECTION}>>"
REFERENCE = "id string, source string, artist string, title string, version double, ratingCount double, averageRating double, capo double, tuning string, key string, genre string, split string, selectionReason string, recordingNotes string"


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    # Spark gives no line numbers; the times in the rows put them in order.
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"))


def read_lab(spark: SparkSession, path: str) -> DataFrame:
    """``path, artist, title, start, end, label`` of ``.lab`` files; rows of fewer than three parts or without numbers go.
    Labels keep their blanks; the artist is the folder, the title the name of the file."""
    parts = F.split("line", r"\s+", 3)
    rows = _lines(spark, path, "*.lab").select("path", parts.alias("p")).where(F.size("p") == 3)
    got = rows.select("path", F.expr("try_cast(p[0] AS DOUBLE)").alias("start"), F.expr("try_cast(p[1] AS DOUBLE)").alias("end"), F.col("p")[2].alias("label"))
    named = got.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    return named.select("path", F.element_at(F.split("path", "/"), -2).alias("artist"), F.regexp_extract("path", r"([^/]+)\.lab$", 1).alias("title"), "start", "end", "label")


def read_best_lab(spark: SparkSession, path: str) -> DataFrame:
    """``entry, start, end, label`` of the best label file of each folder; a label is the third part only."""
    rows = read_lab(spark, path).withColumn("entry", F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    rank = F.array_position(F.array(*[F.lit(n) for n in LAB_ORDER]), F.col("name"))
    ranked = rows.where(rank > 0).withColumn("rank", rank)
    best = ranked.groupBy("entry").agg(F.min("rank").alias("rank"))
    return ranked.join(best, ["entry", "rank"]).select("entry", "start", "end", F.split("label", r"\s+")[0].alias("label"))


def read_artist_index(spark: SparkSession, path: str) -> DataFrame:
    """``entry, artist`` of a CSV with ``id`` and ``artist``; ids are filled up to four digits, rows without either go."""
    rows = spark.read.csv(path, header=True)
    return rows.where(F.col("id").rlike("^[0-9]+$") & (F.trim(F.coalesce("artist", F.lit(""))) != "")).select(F.lpad("id", 4, "0").alias("entry"), F.trim("artist").alias("artist"))


def read_chroma_csv(spark: SparkSession, path: str, bass_first: bool = True, origin: int = 9) -> DataFrame:
    """``path, at, bass, treble, energy`` of files with a time and 24 values a row, after an optional file name. Values
    begin at pitch class ``origin`` and are turned to C; each half adds up to 1; energy is relative to the loudest row."""
    parts = F.split(F.regexp_replace("line", '"', ""), ",")
    rows = _lines(spark, path, "*.csv").select("path", parts.alias("p"))
    base = F.when(F.expr("try_cast(p[0] AS DOUBLE)").isNull(), 1).otherwise(0)
    rows = rows.select("path", "p", base.alias("b")).where(F.size("p") >= F.col("b") + 25)
    numbers = F.transform(F.slice("p", F.col("b") + 1, F.lit(25)), lambda x: x.try_cast("double"))
    rows = rows.select("path", numbers.alias("v")).where(F.forall("v", lambda x: x.isNotNull()))
    first, second = (rolled(F.slice("v", a, 12), origin) for a in (2, 14))
    share = lambda v: F.transform(v, lambda x: safe_div(x, total(v)))
    bass, treble = (first, second) if bass_first else (second, first)
    mass = total(F.slice("v", 2, 24))
    return rows.select("path", F.col("v")[0].alias("at"), share(bass).alias("bass"), share(treble).alias("treble"), safe_div(mass, F.max(mass).over(W.partitionBy("path"))).alias("energy"))


def read_jams(spark: SparkSession, path: str, inferred: bool = False) -> DataFrame:
    """``path, start, end, label`` of the first (``inferred``: the second) chord annotation of JAMS files; rows without
    a positive length go."""
    files = spark.read.schema(f"{JAMS}, _corrupt_record string").option("multiLine", "true").option("recursiveFileLookup", "true").json(path).withColumn("path", F.col("_metadata.file_path"))
    chords = F.get(F.filter("annotations", lambda a: a["namespace"] == "chord"), F.lit(1 if inferred else 0))
    rows = files.select("path", F.inline(chords["data"]))
    return rows.where(F.col("duration") > 0).select("path", F.col("time").alias("start"), (F.col("time") + F.col("duration")).alias("end"), F.col("value").alias("label"))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Track documents by the declared schema; lists that are missing are empty, the split is development."""
    rows = spark.read.schema(TRACK).json(path)
    lists = {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("beats", "downbeats", "chords", "sections")}
    return rows.withColumns(lists | {"split": F.coalesce("split", F.lit("development"))})


def track_problems(tracks: DataFrame) -> DataFrame:
    """``id, problem`` of tracks that break a rule: the split's name, a path to audio or features, the order of starts."""
    starts = F.transform("chords", lambda c: c["start"])
    ordered = F.forall(F.zip_with(F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))), F.slice(starts, 2, F.size(starts)), lambda a, b: b >= a - 1e-6), lambda x: x)
    positive = F.forall("chords", lambda c: c["end"] > c["start"])
    checks = {"split": F.col("split").isin("development", "validation", "test"), "path": F.col("audio_path").isNotNull() | F.col("feature_path").isNotNull(), "length": positive, "order": ordered}
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return tracks.select("id", F.explode(found).alias("problem"))


def read_chord_text(texts: DataFrame) -> DataFrame:
    """``id, place, section, start, chord`` of chord sheets ``(id, text)``: lines ``[Section]``, ``Section: A B``, ``m:ss A`` and
    ``A B x2``. A sheet is left out whole if it is too long, holds markup or a word that is no chord, or has times at
    some chords only or out of order."""
    lines = texts.where((F.length("text") <= 50_000) & ~F.col("text").rlike("<[a-zA-Z/!]")).select("id", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    line = F.trim("raw")
    header = F.regexp_extract(line, r"^\[([^\]]+)\]$", 1)
    titled = F.regexp_extract(line, r"^([A-Za-z][A-Za-z0-9 ]*):\s+\S.*$", 1)
    rows = lines.select("id", "line", F.when(header != "", header).when(titled != "", titled).alias("name"), F.when(header != "", "").when(titled != "", F.regexp_replace(line, r"^[A-Za-z][A-Za-z0-9 ]*:\s+", "")).otherwise(line).alias("body"))
    w = W.partitionBy("id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    stamp = r"^(?:(\d+):)?(\d{1,2}):(\d{2})\s+"
    seconds = F.when(F.col("body").rlike(stamp), F.coalesce(F.regexp_extract("body", stamp, 1).try_cast("int"), F.lit(0)) * 3600 + F.regexp_extract("body", stamp, 2).cast("int") * 60 + F.regexp_extract("body", stamp, 3).cast("int"))
    times = F.least(F.lit(16), F.greatest(F.lit(1), F.coalesce(F.regexp_extract("body", r"\sx(\d+)$", 1).try_cast("int"), F.lit(1))))
    rest = F.trim(F.regexp_replace(F.regexp_replace("body", stamp, ""), r"\sx\d+$", ""))
    rows = rows.select("id", "line", F.last("name", ignorenulls=True).over(w).alias("section"), seconds.cast("double").alias("start"), times.alias("n"), F.filter(F.split(rest, r"[\s|]+"), lambda x: x != "").alias("words"))
    chords = rows.select("id", "line", "section", "start", F.posexplode(F.flatten(F.array_repeat("words", F.col("n")))).alias("k", "word"))
    read = chords.withColumn("chord", L.strict(F.col("word"))["symbol"]).withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("line", "k")) - 1)
    at = F.when(F.col("k") == 0, F.col("start"))
    timed = read.withColumn("start", at).withColumn("before", F.max("start").over(W.partitionBy("id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)))
    sound = timed.groupBy("id").agg((F.bool_and(F.col("chord").isNotNull()) & ((F.count("start") == 0) | (F.count("start") == F.count("*"))) & F.bool_and(F.coalesce(F.col("start") > F.col("before"), F.lit(True)))).alias("ok"))
    return timed.join(sound.where("ok"), "id", "left_semi").select("id", "place", "section", "start", "chord")


def read_pairs(spark: SparkSession, manifest: str) -> DataFrame:
    """``name, reference, prediction`` of a manifest's songs that have both paths."""
    songs = spark.read.schema("onset_tolerance double, songs array<struct<name string, reference string, prediction string>>").option("multiLine", "true").json(manifest).select(F.inline("songs"))
    return songs.where(F.col("reference").isNotNull() & F.col("prediction").isNotNull())


def clipped(regions: DataFrame, start: Column, end: Column) -> DataFrame:
    """Regions ``(start, end, …)`` cut to a span and moved so that it begins at 0; those outside go."""
    a, b = F.greatest(F.col("start"), start), F.least(F.col("end"), end)
    return regions.withColumns({"start": a - start, "end": b - start}).where(F.col("end") > F.col("start"))


def cache_lookup(wanted: DataFrame, cache: DataFrame, versions: dict[str, str]) -> DataFrame:
    """``cache_key, status, payload`` of the keys wanted: hit, stale (another version, or no payload) or miss."""
    fresh = F.lit(True)
    for name, value in versions.items():
        fresh = fresh & (F.coalesce(F.col(name) == value, F.lit(False)))
    held = cache.select("cache_key", (fresh & F.col("payload").isNotNull()).alias("fresh"), "payload")
    status = F.when(F.col("fresh").isNull(), "miss").when(F.col("fresh"), "hit").otherwise("stale")
    return wanted.select("cache_key").join(held, "cache_key", "left").select("cache_key", status.alias("status"), F.when(F.col("fresh"), F.col("payload")).alias("payload"))


def with_paths(rows: DataFrame) -> DataFrame:
    """Rows of which any string holds an absolute path of a machine; reports must have none before they are written."""
    return rows.where(F.to_json(F.struct("*")).rlike(r'"(?:file:/|/(?:home|Users|root|tmp|var|mnt)/|[A-Za-z]:\\\\)'))


def write_report(rows: DataFrame, path: str, form: str = "json") -> None:
    """Writes a report as JSON, CSV with a header, or Parquet, after the check for paths."""
    if with_paths(rows).limit(1).count():
        raise ValueError("the report holds an absolute path")
    writer = rows.write.mode("overwrite")
    if form == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.format(form).save(path)


def markdown_lines(rows: DataFrame) -> DataFrame:
    """``value``: the rows of a report as lines of a Markdown table (a header has to go before them)."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns]), F.lit(" |")).alias("value"))


def read_reference_songs(spark: SparkSession, path: str) -> DataFrame:
    """``id, artist, title, split, key, duration, audio_path, source_url, chords`` of the verified sections of song files, each
    a JSON array. A chord lasts until the next one or the section's end (4 s after the last start if not given), 0.1 s at
    least, and sounds as many semitones higher as the capo sits. Sections without as many starts as chords go; a file that
    can't be read gives no rows."""
    songs = spark.read.schema(SONG).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    each = songs.withColumn("s", F.explode("sections")).where("s.status = 'manually-verified'")
    starts, sequence = F.col("s.manualStartSeconds"), F.col("s.normalizedChordSequence")
    whole = each.where((F.size(starts) > 0) & (F.size(starts) == F.size(sequence)))
    final = F.coalesce("s.endSeconds", F.element_at(starts, -1) + 4)

    def chord(pair: Column, i: Column) -> Column:
        start, following = pair["starts"], F.coalesce(F.get(starts, i + 1), final)
        end = F.when(following > start, following).otherwise(start + 0.1)
        return F.struct(F.round(start, 4).alias("start"), F.round(end, 4).alias("end"), L.annotated_moved(pair["labels"], F.coalesce("s.normalization.capo", F.lit(0))).alias("label"))

    chords = F.transform(F.arrays_zip(starts.alias("starts"), sequence.alias("labels")), chord)
    name = F.coalesce("s.id", F.concat_ws("-", "artist", "title"))
    rows = whole.select(F.replace(F.lower(name), F.lit(" "), F.lit("-")).alias("id"), "artist", "title", F.coalesce("split", F.lit("development")).alias("split"), F.col("s.normalization.soundingKey").alias("key"), F.coalesce("audioPath", F.lit("")).alias("audio_path"), F.coalesce("referenceUrl", F.lit("")).alias("source_url"), chords.alias("chords"))
    return rows.withColumn("duration", F.round(F.element_at("chords", -1)["end"] - F.col("chords")[0]["start"], 4))


def pending_songs(spark: SparkSession, path: str) -> DataFrame:
    """``artist, title, status`` of the songs of such files without a verified section."""
    songs = spark.read.schema(SONG).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    verified = F.exists(F.coalesce("sections", F.array()), lambda s: F.coalesce(s["status"] == "manually-verified", F.lit(False)))
    return songs.where(~verified).select("artist", "title", F.coalesce("status", F.lit("pending")).alias("status"))


def manual_references(rows: DataFrame) -> DataFrame:
    """References as they are stored: texts trimmed and cut to their length, numbers within their bounds, unknown sources
    and splits by default. Rows without an artist or a title go."""
    text = lambda c, n, default="": F.substring(F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(default)), 1, n).alias(c)
    bound = lambda c, most=float("inf"): F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.coalesce(c, F.lit(0.0))))
    number = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double"))
    named = rows.withColumns({c: F.trim(c) for c in ("artist", "title")}).where("artist <> '' AND title <> ''")
    one_of = lambda c, names: F.when(F.col(c).isin(names), F.col(c)).otherwise(names[0]).alias(c)
    return named.select(
        "id", one_of("source", ["ultimate-guitar", "timed-research"]), text("artist", 160), text("title", 160), bound(number("version")).alias("version"), bound(number("ratingCount")).alias("ratingCount"), bound(number("averageRating"), 5).alias("averageRating"),
        bound(number("capo"), 24).alias("capo"), text("tuning", 80, "Standard"), text("key", 32), text("genre", 80, "Unspecified"), one_of("split", ["development", "validation", "test"]), text("selectionReason", 400, "Manually selected chord reference"), text("recordingNotes", 500),
    )


def stored_references(spark: SparkSession, path: str) -> DataFrame:
    """All references of a folder of JSON files, by artist and title; malformed files are left out."""
    rows = spark.read.schema(REFERENCE).option("multiLine", "true").option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(path)
    return rows.where(F.col("id").isNotNull()).orderBy("artist", "title")
