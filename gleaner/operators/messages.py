"""Texts of alerts: short titles, templates, and summaries cut to a length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Phrases of titles with their short forms.
ABBREVIATIONS = {"software development engineer": "SDE", "software engineering": "SWE", "software engineer": "SWE", "machine learning": "ML", "artificial intelligence": "AI", "data science": "DS", "product management": "PM", "quantitative": "Quant"}


def display_value(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n\t]+", " "))


def safe_link(url: Column) -> Column:
    """Web addresses only, else null."""
    return F.when(url.rlike(r"^(?i)https?://[^/?#\s]"), url)


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def safe_diagnostic(message: Column) -> Column:
    """An error's text without addresses, 500 letters at most."""
    return F.left(F.regexp_replace(message, r"https?://\S+", "[url]"), F.lit(500))


def compact_title(title: Column, abbreviations: dict[str, str] = ABBREVIATIONS) -> Column:
    """The short form of the phrase that a title holds first, of several there the longest; else the title
    without words for an internship."""
    whole = display_value(title)
    low = F.lower(whole)
    hits = [F.when(F.contains(low, F.lit(k.lower())), F.struct(F.locate(k.lower(), low).alias("at"), F.lit(-len(k)).alias("length"), F.lit(v).alias("short"))) for k, v in abbreviations.items()]
    first = F.array_min(F.array_compact(F.array(*hits)))["short"]
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, r"(?i)\b(?:internship|intern|co-op)\b", ""), r"[\s\x{2013}\x{2014}-]+$", ""), r"\s{2,}", " "))
    return F.coalesce(first, F.when(plain != "", plain), whole)


def render(template: str, values: dict[str, Column]) -> Column:
    """A template with its ``{names}`` replaced, lines that became empty dropped."""
    parts, rest = [], template
    while rest:
        at = min((i for k in values if (i := rest.find("{" + k + "}")) >= 0), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        if at:
            parts.append(F.lit(rest[:at]))
        name = rest[at + 1 : rest.index("}", at)]
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = rest[rest.index("}", at) + 1 :]
    out = F.concat(*parts) if parts else F.lit("")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\n[ \t]*\n+", "\n"), r"^\s+|\s+$", ""))


def summary_chunks(alerts: DataFrame, device: str, order: str, key: str, body: str, limit: int = 1200) -> DataFrame:
    """(device, key, chunk): alerts in order in chunks, a new one where the texts with two letters each would pass ``limit``.

    ``alerts`` are those of a run after its caps, so a device's are few; the fold carries the length so far.
    """
    item = F.struct(F.col(order).alias("order"), F.col(key).alias("key"), (F.length(body) + 2).alias("size"))
    listed = alerts.groupBy(device).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("length"), F.array().cast("array<int>").alias("chunks"))

    def step(acc: Column, x: Column) -> Column:
        over = (acc["length"] > 0) & (acc["length"] + x["size"] > limit)
        chunk = F.when(over, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(over, x["size"]).otherwise(acc["length"] + x["size"]).alias("length"), F.concat(acc["chunks"], F.array(chunk)).alias("chunks"))

    chunks = F.aggregate("items", start, step, lambda acc: acc["chunks"])
    pairs = F.arrays_zip(F.transform("items", lambda x: x["key"]).alias("key"), chunks.alias("chunk"))
    return listed.select(device, F.explode(pairs).alias("p")).select(device, F.col("p.key").alias(key), F.col("p.chunk").alias("chunk"))
