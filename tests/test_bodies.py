"""Bodies that are shown as Columns against the parser, on random bytes and content types."""

import random

import pytest
from pyspark.sql import functions as F

from lacquer.functions import policy as P
from lacquer.operators import formats as M

PIECES = ["a", "token", "=", "&", "&&", "+", "%41", "%7e", "%20", "%e9", "%C3%A9", "%zz", "%", "low", "mid", "é", "日", "{", "[", "\n", " ", "x y", "~", "*", "-._", "<>", "\t", "pass word", "1"]
KINDS = [
    None, "application/x-www-form-urlencoded", "application/x-www-form-urlencoded; charset=utf-8", " Application/X-WWW-Form-urlencoded ", "text/plain", "text/html; charset=utf-8", "text/json", "text/x+json",
    "application/json", "application/zip", "multipart/form-data; boundary=b", "broken", "", "a/b; c", "a/b;", "a/b; c=d; c=e", 'text/plain; a="q"', "application/x-ndjson", "x/json", "text/plain;", "a/b ;c=d", "a/b\n", "TEXT/Plain",
]
BASE = P.standard().builder().fields(lambda x: x.low("low").medium("mid"))


@pytest.fixture(scope="module")
def bodies(spark):
    r, rows = random.Random(1), []
    for i in range(3000):
        b = "".join(r.choice(PIECES) for _ in range(r.randint(0, 12))).encode() + (bytes([r.choice([255, 0xC3, 0x80, 0])]) if r.random() < 0.15 else b"")
        b = b * 40 if r.random() < 0.03 else b
        rows.append((i, b if r.random() > 0.01 else None, r.choice(KINDS), r.choice([None, False, False, False, True]), r.choice([None, None, len(b), len(b) + 3])))
    return spark.createDataFrame(rows, "i int, b binary, k string, c boolean, n long").cache()


@pytest.mark.parametrize("policy", [BASE.build(), BASE.http(text_body="pass_through").limits(max_output_bytes=80, max_items=3).build(), P.strict(), P.disabled()])
def test_bodies_equal_the_parser(bodies, policy):
    args = M._body(F.col("b"), F.col("k"), F.col("c"), F.col("n"))
    given = (F.col("b"), policy, F.col("k"), F.col("c"), F.col("n"))
    rows = bodies.select(
        M.redact_http_body(*given).alias("r"), M._apply(policy, M.body_text, False, *args).alias("want_r"), M.inspect_http_body(*given).alias("i"), M._apply(policy, M.body_text, True, *args).alias("want_i"),
        M.Body(*args[:3], policy).plain().alias("plain"),
    ).collect()
    assert all(x.r == x.want_r and x.i == x.want_i for x in rows)
    assert sum(bool(x.plain) for x in rows) > 500


def test_ordinary_forms_and_texts_need_no_parser(spark):
    rows = [(b"token=abc&page=7&note=a+b%20c", "application/x-www-form-urlencoded; charset=utf-8"), (b"<p>", "text/html"), (b"\xff\x00", None), (b"", "x/y"), (b"PK", "application/zip"), (b"x", "broken")]
    df = spark.createDataFrame(rows, "b binary, k string")
    assert all(r.p for r in df.select(M.Body(F.col("b"), F.col("k"), F.lit(False), P.standard()).plain().alias("p")).collect())
