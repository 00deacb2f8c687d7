"""Source divergence against plain counting: copies, null names, groups without terms, ties, several hand-overs."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from staveframe.llm import divergence, queries

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def wanted(rows):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = Counter(TERM.findall((text or "").translate(LOWER)))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(found.keys())
    out = []
    for lang, df in docs.items():
        kept = [t for t, n in df.items() if n >= 30]
        groups = {s: c for (of, s), c in counts.items() if of == lang}
        total = sum(groups.values(), Counter())

        def share(c, kept=kept):
            whole = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // whole for t in kept}

        p, q = {s: share(c) for s, c in groups.items()}, share(total)
        for s, c in groups.items():
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            over = [(q[t] - p[s][t], t.encode()) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:50])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def corpus():
    """A hot text with copies in several sources, words of any script, names that are null, a language that keeps no term."""
    rows = []
    for k in range(240):
        words = [f"word{'abcdefghij'[j % 10]}{chr(97 + j // 10)}" for j in range(90) if (k * 7 + j * j) % 11 < 4]
        rows.append(("en", f"s{k % 5}", " ".join(words).title() + " x1y É漢字 É" + "\x00\t" + "z" * (k % 3)))
    rows += [("en", f"s{k % 4}", "The same text, the same words: wordaa wordba") for k in range(300)]
    rows += [(None, None, "null names here") for _ in range(40)] + [("", "other", "NULL names there") for _ in range(35)] + [("fr", "a", "peu"), ("fr", "b", None), ("fr", None, ""), ("de", "only", "allein " * 3)]
    rows += [("en", "wordless", None), ("en", "wordless", "123 456"), ("en", "s0", "long " * 50_000)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_like_plain_counting(spark, small, monkeypatch):
    if small:  # tasks hand over what they remember after every few texts
        monkeypatch.setattr(divergence, "REMEMBERED", 5)
        monkeypatch.setattr(divergence, "HELD", 50)
    rows = corpus()
    frame = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit(f"extra {c}") for c in ("digest", "copies", "term", "n", "docs", "p", "q", "v", "a", "b", "item", "value", "rank", "x.y")}).repartition(5)
    got = sorted(tuple(r) for r in divergence.audit(frame).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == wanted(rows)
    assert divergence.audit(frame.limit(0)).count() == 0


def test_counts_beyond_a_long(spark):
    """1000000000 (count + 5) leaves the range of a long; the share doesn't."""
    rows = [(10**13, 3 * 10**13 + 7), (0, 10), (5, 10), (10**14, 10**14 + 5), (7, 9_000_000_000_001)]
    got = spark.createDataFrame(rows, "n long, total long").select(divergence._share(F.col("n"), F.col("total")).alias("p"))
    assert [r.p for r in got.collect()] == [1 + 10**9 * (n + 5) // t for n, t in rows]


def test_query_like_its_sql(spark, tmp_path):
    rows = [(k, t, lang, s) for k, (lang, s, t) in enumerate(corpus()) if "\x00" not in (t or "")] + [(9000 + k, "alpha beta Gamma " * (k % 4), "en", f"s{k % 3}") for k in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op13_divergence(spark, str(tmp_path)).select("lang", "source", "part", "item", "value", "rank").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(queries.OP13_SQL).fetchall())
