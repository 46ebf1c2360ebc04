import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslake.functions import text as T


def run(spark, f, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def normalize(s):
    s = re.sub("\r\n?", "\n", s)
    s = re.sub("[\x00-\x08\x0b-\x1f\x7f-\x9f]", " ", s)
    s = re.sub("[­​‎‏‪-‮⁠⁦-⁩﻿]", "", s)
    s = re.sub("[ \t   -   　]+", " ", s)
    s = "\n".join(x.strip() for x in s.split("\n"))
    return re.sub("\n{3,}", "\n\n", s).strip()


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\r\t\x00 ​  ـ\x85é٣", max_size=40), min_size=1, max_size=60))
def test_normalize_light_matches_python(spark, texts):
    assert run(spark, T.normalize_light, *texts) == [normalize(t) for t in texts]


def test_clean_text_folds_presentation_forms_only(spark):
    assert run(spark, T.clean_text, "ﻻ x² ـﬁ", None) == [unicodedata.normalize("NFKC", "ﻻ") + " x² fi", None]


@pytest.mark.parametrize(
    ("text", "status", "reason"),
    [
        ("A clean page of text with quite enough letters.", "ok", None),
        ("", "empty", "no-text"),
        ("  12 \n ", "empty", "no-text"),
        (None, "empty", "no-text"),
        ("/g875 /I103+ /uni0627 /DC3 " * 10, "junk", "glyph-names"),
        ("\x01\x02abc" * 20, "junk", "control-chars"),
        ("" * 30, "junk", "private-use"),
        ("Ã©Ã¨Ø§Ù„" * 20, "junk", "mojibake"),
        ("�" * 50, "junk", "replacement-chars"),
        ("+-*/=<> " * 20, "junk", "few-letters"),
        ("a, b. c; d! " * 12, "degraded", "broken-words"),
        ("a b c d e f g h i j k l m n o p q r s t " * 2, "degraded", "broken-words"),
    ],
)
def test_grades(spark, text, status, reason):
    g = T.grade(spark.createDataFrame([(text,)], "v string"), "v").first()["grade"]
    assert g["status"] == status
    assert reason is None and not g["reasons"] or reason in g["reasons"]


def graded(raw):
    """The grader's figures, letter by letter."""
    clean = normalize("".join(unicodedata.normalize("NFKC", c) if "\ufb00" <= c <= "\ufdff" or "\ufe70" <= c <= "\ufefe" else c for c in raw).replace("\u0640", "").replace("\ufffd", ""))
    solid = [c for c in raw if not c.isspace()]
    words = [[c for c in w if c.isalpha()] for w in clean.split()]
    words = [w for w in words if w]
    share = lambda f: round(sum(map(f, solid)) / len(solid), 4) if solid else 0.0
    odd = lambda c: "\xa8" == c or "\xc0" <= c <= "\xff" and c not in "\xd7\xf7" or c in "Œ†"
    arabic = lambda c: any(a <= ord(c) <= b for a, b in ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)))
    control = lambda c: ord(c) < 32 or 0x7F <= ord(c) <= 0x9F
    return len(solid), share(odd), share(arabic), share(control), share(lambda c: c.isalnum() and not odd(c)), round(sum(len(w) == 1 for w in words) / len(words), 4) if words else 0.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab ,.\n\t\x00\x85é×قﻻ٣\u200b\u2028Œ7½", max_size=60), min_size=1, max_size=50))
def test_grader_counts_like_letter_by_letter(spark, texts):
    df = T.grade(spark.createDataFrame(list(enumerate(texts)), "i int, v string"), "v", "g").orderBy("i")
    for t, r in zip(texts, df.collect(), strict=True):
        g, want = r["g"], graded(t)
        assert (g["chars"], g["mojibake"], g["arabic"], g["control"], g["letters"]) == want[:5]
        assert g["single_letter_words"] == (want[5] if g["status"] in ("ok", "degraded") else None)


def test_few_words_have_their_share(spark):
    g = T.grade(spark.createDataFrame([("a b cde fghij klmno pqrst uvwxy",)], "v string"), "v").first()["grade"]
    assert g["status"] == "ok" and g["single_letter_words"] == 0.2857


def test_bodies(spark):
    body = lambda path, *v: run(spark, lambda c: T.redact_body(F.lit(path), c, 60), *v)
    assert body("/ingest", '{"fileBase64": "abcd", "x": 1, "fileBase64" :"ab"}', "{}", None) == ['{"fileBase64": "<4 base64 chars>", "x": 1, "fileBase64" :"<2\n... [truncated 16 more chars]', "{}", ""]
    whole = '{"notebookId": "n", "sourceId": 5, "pages": [{"text": "abc"}, {"text": null}, 7, {"page": 1}]}'
    assert body("/ingest/text/", whole) == ['{"notebookId": "n", "sourceId": 5, "fileName": null, "collection": null, "pages": 4, "chars": 3}']
    assert body("/ingest/text", '{"pages": null}', "{}") == ['{"notebookId": null, "sourceId": null, "fileName": null, "collection": null, "pages": 0, "chars": 0}'] * 2
    assert body("/ingest/text", '{"pages": [', "[1]", '{"pages": "x&token=s"}') == ['{"pages": [', "[1]", '{"pages": "x&token=<redacted>"}']


def test_small_formats(spark):
    assert run(spark, T.human_bytes, 0, 1023, 1024, 1536, 1048576, None, kind="bigint") == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", None]
    assert run(spark, T.redact_url, "http://x/?a=1&TOKEN=s3cret&b=2", None) == ["http://x/?a=1&TOKEN=<redacted>&b=2", ""]
    assert run(spark, T.no_figures, " no figures. ", "", "[Figure] a") == [True, True, False]
    assert run(spark, T.figure_lines, "x\n[Figure] a\n[Figure] b", "only words", "no figures", None) == ["[Figure] a\n[Figure] b", "[Figure] only words", "", ""]
    assert [[tuple(p) for p in x] for x in run(spark, T.parse_pairs, "a:1, b ,,c:")] == [[("a", "1"), ("b", None), ("c", None)]]
    assert run(spark, T.is_collection_name, "ab", "a", "a b", "x__y-z9") == [False, False, False, True]


def test_redact_body(spark):
    rows = spark.createDataFrame([("/ingest/text", '{"notebookId":"n","pages":[{"text":"abc"},{"text":null}]}'), ("/x", '{"fileBase64":"AAAA","u":"?key=1"}'), ("/x", "y" * 2100), ("/ingest/text/", "not json")], "p string, b string")
    out = [r[0] for r in rows.select(T.redact_body(F.col("p"), F.col("b"))).collect()]
    assert '"pages": 2' in out[0] and '"chars": 3' in out[0]
    assert out[1] == '{"fileBase64":"<4 base64 chars>","u":"?key=<redacted>"}'
    assert out[2] == "y" * 2000 + "\n... [truncated 100 more chars]"
    assert out[3] == "not json"


def test_clean_ids_keeps_the_first(spark):
    rows = spark.createDataFrame([(["b ", "a", " b", "", None],)], "v array<string>")
    assert rows.select(T.clean_ids(F.col("v"))).first()[0] == ["b", "a"]
