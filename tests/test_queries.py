"""Every registered query of the core against its SQL in DuckDB, and the pure functions against cases."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framelode.functions import audio, matching, text
from framelode.plans import catalog
from framelode.sources import subtitles

SF = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in os.listdir(SF) if f.endswith(".parquet")]


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=str)
    if name not in catalog.oracle_sql():
        assert got
        return
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    order = [rel.columns.index(c) for c in df.columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=str)


def walked(t):
    """Tags, then entities, then trimmed lines, one sign at a time."""
    out, tag = "", None
    for c in t:
        if c == "<":
            tag = ""
        elif c == ">" and tag is not None:
            if tag.strip().lower() in ("br", "br/", "p", "/p") and out and out[-1] != "\n":
                out += "\n"
            tag = None
        elif tag is not None:
            tag += c
        else:
            out += c
    for name, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        at = out.lower().find(name)
        while at >= 0:
            out = out[:at] + sign + out[at + len(name) :]
            at = out.lower().find(name, at + len(sign))
    return "\n".join(x.strip() for x in out.split("\n") if x.strip())


def test_tags(spark):
    assert text.strip_tags("a<br>b<br />c<p>d<p class=x>e") == "a\nbc\nde"
    assert text.strip_tags("x <b <i>y</i> z <open") == "x y z"
    assert text.strip_tags("x &lt;b&gt; y&#39;s<BR >z &apos;") == "x <b> y's\nz &apos;"
    rnd = random.Random(1)
    parts = ["<", ">", "br", "BR/", " ", "/p", "p", "&amp;", "&LT;", "lt;", "&#39;", "&nbsp;", "a", "\n", "\t", "\u00a0", "é"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.strip_html(F.col("t"))).collect()
    for t, got in rows:
        assert text.strip_tags(t) == got == walked(t), repr(t)


def test_wrap():
    assert text.wrap("short", 10) == "short"
    assert text.wrap("aaaa bbbb cccc dddd", 10) == "aaaa bbbb\ncccc dddd"
    assert text.wrap("a" * 12, 10) == "a" * 6 + "\n" + "a" * 6
    assert text.wrap("a" * 30, 10) == "a" * 10 + "\n" + "a" * 20
    assert text.wrap("one\r\ntwo\tthree", 5) == "one  two\nthree" and text.wrap("a\nb", 9) == "a b"
    assert text.wrap("😀" * 4, 3) == "😀\ufffd\n\ufffd😀😀" and text.wrap("   ", 2) == ""


def test_times(spark):
    cases = {"00:00:01,": 1.0, "00:00:01,5 x": 1.5, " 1:02:03.4567 ": 3723.456, "00:01.000": None, "00:60:00": None, "0:0:1": 1.0, "a:0:1": None, "100:00:00,25": 360000.25}
    for t, got in spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.parse_srt_time(F.col("t"))).collect():
        assert got == cases[t] and subtitles.seconds(t) == cases[t], t


def test_episode_scores(spark):
    def tokens(name):
        return matching.dot_tokens(F.lit(name))

    def score(a, b):
        f = [F.struct(tokens(x).alias("tokens"), matching.stable_tokens(tokens(x)).alias("stable")) for x in (a, b)]
        return spark.range(1).select(matching.similarity(f[0], f[1], F.lit(True))).first()[0]

    assert score("Show.E03.1080p", "Show.E04.1080p") == 10_000 + 1000 + 200 + 5
    assert score("Show.Title.E03.240101.1080p", "Show.Title.E04.240108.720p") == 20_000 + 667 + 200 + 5
    assert score("Show.E03", "Show.E04.a.b") is None  # a third alike
    assert score("Show.E03.a.b", "Show.E04.c.d") is None  # one stable token in common
    assert score("a.Show.E03.x", "b.Show.E04.x") is None  # two in common without a leading one
    assert score("E03.a.b.c", "E04.a.b.c") is None  # no title


def test_optional_values_stay_null(spark):
    rows = spark.createDataFrame([("12 %",), ("x",), ("",), ("-3",), ("1e3%",), (None,)], "t string").select(text.status_progress(F.col("t"))).collect()
    assert [r[0] for r in rows] == [12.0, None, None, 0.0, 100.0, None]


def test_inverse_transform():
    rnd = np.random.default_rng(3)
    for n in (8, 128):
        x = rnd.normal(size=n)
        k, t = np.arange(n), np.arange(2 * n)[:, None]
        want = (x * np.cos(np.pi / n * (t + 0.5 + n / 2) * (k + 0.5))).sum(1) / n
        assert audio.imdct(x) == pytest.approx(want)
    # windowed blocks of a signal, transformed and back, and overlapped: their sum is half the signal under this scale
    n, signal = 64, rnd.normal(size=64 * 6)
    window = np.array(audio.sine_window(n))
    k, t = np.arange(n)[:, None], np.arange(2 * n)
    blocks = [audio.imdct((np.cos(np.pi / n * (t + 0.5 + n / 2) * (k + 0.5)) * signal[a : a + 2 * n] * np.concatenate([window, window[::-1]])).sum(1)) for a in range(0, len(signal) - n, n)]
    out = audio.overlap_add(np.array(blocks), window)
    assert out[1:].ravel() == pytest.approx(signal[n : n * len(blocks)] / 2)
    assert sum(x * x for x in audio.kbd_window(n, 4.0)) == pytest.approx(n / 2, rel=0.02)


def test_low_pass():
    taps = audio.low_pass()
    assert len(taps) == audio.TAPS and abs(sum(taps) - 1) < 1e-12 and taps == pytest.approx(taps[::-1])
