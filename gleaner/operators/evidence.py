"""What a page says of a role: its text, how far it agrees with the role's title, and how sure that makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.text import ENTITIES, collapse, folded

#: Words that do not tell roles apart, and words of a season or kind that a phrase leaves out.
IGNORED = "intern coop summer fall winter spring the and for with at of to in new grad university college software technical technology technologies".split()
SEASONAL = "intern coop summer fall winter spring".split()
#: Fixed values: (pattern, stem) of words of one meaning, in order.
STEMS = [(r"co[-\s]?op", "coop"), ("internships?", "intern"), ("engineerings?", "engineer"), ("developers?|development", "develop"), ("analysts?", "analyst"), ("scientists?", "scientist"), ("researchers?", "researcher"), ("designers?", "design")]
#: Words of a role, of any job page, of career pages in general, and of a job's description.
ROLE = "intern(?:ship)?|engineer|developer|scientist|analyst|designer|manager|researcher|associate|consultant|apprentice|co-?op"
GENERIC = r"candidate experience|career section|job opportunities|open roles?|jobs? (?:and employment )?at|careers? at|join (?:our )?team|careers?"
DESCRIPTION = r"responsibilities|qualifications|requirements|what you(?:'|\x{2019})ll do|about the role|apply|intern(?:ship)?"
#: Letters of a page's text that are kept, and that make it substantial.
EXCERPT, SUBSTANTIAL = 12_000, 300
#: Arrays and @graph nodes within one another that a structured block may have.
DEPTH = 6


def text_of(html: Column) -> Column:
    """Scripts, styles and drawings dropped, tags as spaces, white space collapsed, then entities decoded once."""
    out = F.regexp_replace(html, r"(?is)<(script|style|svg)\b[^>]*>.*?</\1>", " ")
    out = collapse(F.regexp_replace(out, "<[^>]*>", " "))
    for name in [*(k for k in ENTITIES if k != "&amp;"), "&amp;"]:
        out = F.regexp_replace(out, "(?i)" + name, ENTITIES[name])
    return out


def structured_descriptions(html: Column) -> Column:
    """The descriptions of all job postings in a page's JSON-LD blocks, block by block and level by level.

    A block is an object or an array; ``@graph`` holds more of either. Malformed blocks are passed over.
    """
    block = r"(?is)<script\b[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
    variants = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    listed = lambda v: F.coalesce(variants(v, "$"), F.array(v))

    def of(text: Column) -> Column:
        level = listed(F.try_parse_json(text))
        found = None
        for _ in range(DEPTH):
            said = F.transform(level, _description)
            found = said if found is None else F.concat(found, said)
            level = F.flatten(F.transform(level, _children))
        return F.filter(found, lambda x: x.isNotNull())

    return F.flatten(F.transform(F.regexp_extract_all(html, F.lit(block), F.lit(1)), of))


def _description(v: Column) -> Column:
    kinds = F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.try_variant_get(v, "$['@type']", "string")))
    is_text = F.schema_of_variant(F.try_variant_get(v, "$.description", "variant")) == "STRING"
    return F.when(F.array_contains(kinds, "JobPosting") & is_text, F.try_variant_get(v, "$.description", "string"))


def _children(v: Column) -> Column:
    empty = F.array().cast("array<variant>")
    graph = F.try_variant_get(v, "$['@graph']", "variant")
    inside = F.coalesce(F.try_variant_get(graph, "$", "array<variant>"), F.when(graph.isNotNull(), F.array(graph)), empty)
    return F.concat(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), empty), inside)


def with_content(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with excerpt, content_hash and content_source: JSON-LD before ``main`` before ``body`` before all."""
    h = F.coalesce(F.col(html), F.lit(""))
    inner = lambda tag: F.regexp_extract(h, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    has = lambda tag: inner(tag) != ""
    structured = F.get(structured_descriptions(h), F.lit(0))
    out = pages.withColumn("_structured", structured)
    source = F.when(F.col("_structured").isNotNull(), "json-ld").when(has("main"), "main").otherwise("body")
    raw = F.when(F.col("_structured").isNotNull(), F.col("_structured")).when(has("main"), inner("main")).when(has("body"), inner("body")).otherwise(h)
    out = out.withColumn("_text", text_of(raw)).withColumn("content_source", F.when(F.col("_text") != "", source))
    return out.withColumn("excerpt", F.when(F.col("_text") != "", F.substring("_text", 1, EXCERPT))).withColumn("content_hash", F.when(F.col("_text") != "", F.sha2("_text", 256))).drop("_structured", "_text")


def role_text(text: Column, fold=folded) -> Column:
    """The text with stems for words of one meaning, as words one space apart."""
    out = F.lower(fold(F.coalesce(text, F.lit(""))))
    for pattern, stem in STEMS:
        out = F.regexp_replace(out, pattern, f" {stem} ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[^a-z0-9+#.]+", " "), " +", " "))


def role_agreement(role: Column, page: Column) -> Column:
    """How far a page's text holds a role's: ``strong``, ``partial`` or ``weak``; both as :func:`role_text` gives them."""
    words, said = F.split(role, " "), F.split(page, " ")
    phrase = F.array_join(F.filter(words, lambda w: ~w.isin(SEASONAL)), " ")
    terms = F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(IGNORED) & ~w.rlike(r"^202\d$")))
    ratio = F.size(F.array_intersect(terms, said)) / F.size(terms)
    return (
        F.when(page == "", "weak").when(F.contains(phrase, F.lit(" ")) & F.contains(page, phrase), "strong").when(F.size(terms) == 0, "partial")
        .when(ratio >= 0.75, "strong").when(ratio >= 0.4, "partial").otherwise("weak")
    )


def generic_title(title: Column) -> Column:
    """A title of a career page rather than of a role: it names no role, and careers or at most three words."""
    value = collapse(F.coalesce(title, F.lit("")))
    return (value != "") & ~value.rlike(rf"(?i)\b(?:{ROLE})\b") & (value.rlike(rf"(?i)\b(?:{GENERIC})\b") | (F.size(F.split(value, r"\s+")) <= 3))


def level_of(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 45, "medium").otherwise("low")


def page_confidence(is_html: Column, title: Column, description: Column, excerpt: Column, expected_id: Column, id_present: Column, restricted: Column, unavailable: Column) -> Column:
    """(score, signals) of a page: points for what it shows, 65 at most for a general career page."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    long = F.coalesce(F.length(excerpt) >= SUBSTANTIAL, F.lit(False))
    wanted = some(expected_id)
    rules = [
        (F.lit(True), 10, "HTML response"),
        (some(title), 20, "page title"),
        (some(title) & title.rlike(rf"(?i)\b(?:{ROLE}|job|position|role)\b"), 10, "role-like title"),
        (some(description), 15, "page description"),
        (long, 10, "substantive page content"),
        (long & excerpt.rlike(rf"(?i)\b(?:{DESCRIPTION})\b"), 5, "job-description language"),
        (wanted & F.coalesce(id_present, F.lit(False)), 20, "posting ID appears in page"),
        (wanted & ~F.coalesce(id_present, F.lit(False)), 0, "posting ID absent from server HTML"),
        (~wanted & some(title), 5, "slug-based or opaque URL"),
        (generic_title(title), 0, "generic career-page title"),
    ]
    score, signals = F.lit(25), [F.lit("destination reached")]
    for holds, points, name in rules:
        score = score + F.when(holds, points).otherwise(0)
        signals.append(F.when(holds, name))
    score = F.least(F.when(generic_title(title), F.least(score, F.lit(65))).otherwise(score), F.lit(100))
    barred = lambda name: F.struct(F.lit(25).alias("score"), F.array(F.lit("destination reached"), F.lit(name)).alias("signals"))
    return F.when(restricted, barred("access restricted to scraper")).when(unavailable, barred("temporary server failure")).when(~is_html, barred("non-HTML destination")).otherwise(F.struct(score.cast("int").alias("score"), F.array_compact(F.array(*signals)).alias("signals")))


def assess(base: Column, agreement: Column, title: Column, excerpt: Column, redirected: Column) -> Column:
    """(score, level, recommendation, signals) of a page for a listing.

    Substantial job text that agrees strongly is worth 75 at least; a page that a posting was sent to in
    general, or a general career page that does not agree strongly, 65 at most.
    """
    strong = agreement == "strong"
    content = strong & F.coalesce(F.length(excerpt) >= SUBSTANTIAL, F.lit(False)) & F.array_contains(base["signals"], "job-description language")
    general = ~redirected & generic_title(title) & ~strong
    score = F.when(content, F.greatest(base["score"], F.lit(75))).otherwise(base["score"])
    score = F.when(redirected | general, F.least(score, F.lit(65))).otherwise(score)
    more = F.array_compact(F.array(F.when(content, "source role matches public job content"), F.when(redirected, "specific posting redirected to generic destination"), F.when(general, "generic career-page title lacks source-role match")))
    level = level_of(score)
    advice = F.when(level == "high", "alert-eligible").when(level == "medium", "catalog-only").otherwise("review")
    return F.struct(score.alias("score"), level.alias("level"), advice.alias("recommendation"), F.concat(base["signals"], more).alias("signals"))
