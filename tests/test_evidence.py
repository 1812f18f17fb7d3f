"""Page evidence: content, agreement and confidence, with expected values written out by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import evidence

LONG = "Responsibilities: build compilers with our team. " * 10


def content(spark, *html):
    return [tuple(r) for r in evidence.with_content(spark.createDataFrame([(h,) for h in html], "html string").coalesce(1)).select("content_source", "excerpt", "content_hash").collect()]


def ld(value):
    return f'<html><script type="application/ld+json">{value if isinstance(value, str) else json.dumps(value)}</script><body>other</body></html>'


def test_structured_text_comes_first(spark):
    job = {"@type": "JobPosting", "description": "<p>Build &amp; test</p><style>x</style> compilers"}
    text = "Build & test compilers"
    got = content(spark, ld(job), ld([{"@type": "Thing"}, job]), ld({"@graph": [{"@graph": {"@type": ["Thing", "JobPosting"], "description": "<p>Build &amp; test</p> compilers"}}]}), ld([[[job]]]))
    assert got == [("json-ld", text, hashlib.sha256(text.encode()).hexdigest())] * 4


def test_content_without_structure(spark):
    got = content(spark, ld("{broken"), ld({"@type": "JobPosting", "description": 5}), "<main class='m'>Main <b>text</b></main><body>b</body>", "<body> B &lt; </body>", "just <i>text</i>", "", None, "<style>x</style>")
    assert [x[:2] for x in got] == [("body", "other"), ("body", "other"), ("main", "Main text"), ("body", "B <"), ("body", "just text"), (None, None), (None, None), (None, None)]
    assert len(content(spark, "<body>" + "a" * 20_000)[0][1]) == 12_000


def agreement(spark, role, page):
    return spark.range(1).select(evidence.role_agreement(evidence.role_text(F.lit(role)), evidence.role_text(F.lit(page)))).first()[0]


@pytest.mark.parametrize(
    "role, page, want",
    [("Compiler Engineer Intern", "We hire a compiler engineering intern", "strong"), ("Compiler Engineer Intern", "compilers", "weak"), ("Compiler Engineer Intern", "engineer wanted", "partial"), ("Summer Intern", "any page", "partial"), ("Compiler Engineer Intern", "", "weak"), ("Développeur Co-op 2026", "un developpeur", "strong")],
)
def test_agreement(spark, role, page, want):
    assert agreement(spark, role, page) == want


def assessed(spark, title, excerpt, role, expected=None, present=None, redirected=False, description="d", html=True, restricted=False):
    s = lambda x: F.lit(x).cast("string")
    base = evidence.page_confidence(F.lit(html), s(title), s(description), s(excerpt), s(expected), F.lit(present).cast("boolean"), F.lit(restricted), F.lit(False))
    agrees = evidence.role_agreement(evidence.role_text(s(role)), evidence.role_text(F.concat_ws(" ", s(title), s(description), s(excerpt))))
    r = spark.range(1).select(base.alias("b"), evidence.assess(base, agrees, s(title), s(excerpt), F.lit(redirected)).alias("a")).first()
    return r["b"]["score"], r["a"]["score"], r["a"]["recommendation"]


def test_scores(spark):
    assert assessed(spark, "Compiler Engineer Intern", LONG, "Compiler Engineer Intern") == (100, 100, "alert-eligible")
    assert assessed(spark, "Compiler Engineer Intern", LONG, "Compiler Engineer Intern", "123456", False) == (95, 95, "alert-eligible")
    assert assessed(spark, "Careers at Acme", "short", "Compiler Engineer Intern") == (65, 65, "catalog-only")
    assert assessed(spark, "Careers at Acme", LONG, "Compilers with our team intern") == (65, 75, "alert-eligible")
    body = "Software Engineering Intern. " * 20 + "Responsibilities include testing distributed systems."
    assert assessed(spark, None, body, "Software Engineer Intern", description="Apply for this role.") == (65, 75, "alert-eligible")
    assert assessed(spark, "JPMC Candidate Experience page", "", "Software Engineer Intern", "123456", False) == (65, 65, "catalog-only")
    assert assessed(spark, "Compiler Engineer Intern", LONG, "Compiler Engineer Intern", redirected=True) == (100, 65, "catalog-only")
    assert assessed(spark, None, None, "Compiler Engineer Intern", description=None) == (35, 35, "review")
    assert assessed(spark, "x", LONG, "y", html=False) == (25, 25, "review") and assessed(spark, "x", LONG, "y", restricted=True) == (25, 25, "review")
