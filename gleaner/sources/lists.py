"""List documents: tables in Markdown or HTML, and sections of a company with its roles.

One scanner each gives tables of raw cells; one reading turns tables into postings, and a machine over
lines reads the section layout. ``posting_lists`` is a Spark data source over files of such documents,
:func:`parse_lists` the same over a column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

ROW = StructType([StructField("row", IntegerType()), *(StructField(x, StringType()) for x in ("company", "title", "location", "apply_url", "pay", "posted")), *(StructField(x, BooleanType()) for x in ("closed", "citizenship", "degree"))])
#: Header words of the columns, what closes a row, marks of requirements and the codes of roles.
COLUMNS = {"company": r"company|employer", "title": r"role|position|title", "location": r"location", "apply": r"apply|application|^link$|^posting$", "pay": r"compensation|salary|pay", "posted": r"date|posted"}
CLOSED = re.compile(r"\b(?:closed|inactive|filled|expired)\b|🔒", re.IGNORECASE | re.ASCII)
CITIZENSHIP = re.compile(r"🇺🇸|\b(?:requires?|must be)\s+(?:a\s+)?(?:u\.?s\.?|united states)\s+citizen(?:ship)?\b", re.IGNORECASE)
DEGREE = re.compile(r"🎓|\b(?:advanced degree|master'?s|ph\.?d\.?|mba)\b", re.IGNORECASE)
ROLE_CODES = {"QD": "Quantitative Developer Intern", "QR": "Quantitative Research Intern", "QT": "Quantitative Trading Intern", "SWE": "Software Engineering Intern", "HW": "Hardware Engineering Intern"}
_URL = r"https?://[^\s)]+"
#: Where a cell's address may stand, best first: a link around a picture, a link, an anchor, the bare address.
_LINKS = [re.compile(p, re.IGNORECASE) for p in (rf"\[!\[[^\]]*\]\([^)]*\)\]\(({_URL})\)", rf"\[[^\]]*\]\(({_URL})\)", r"<a\s[^>]*href\s*=\s*[\"'](https?://[^\"']+)[\"']", r"(?<![\"'(])(https?://[^\s<>)]+)")]
_RULE = re.compile(r"\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*")


def plain(cell: str) -> str:
    """A cell's text without tags, link targets and emphasis."""
    cell = re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", re.sub(r"<[^>]*>", " ", cell))
    return re.sub(r"\s+", " ", re.sub(r"(?i)&nbsp;", " ", re.sub(r"[*_`]", "", cell))).strip()


def first_link(cell: str) -> str | None:
    for pattern in _LINKS:
        for found in pattern.finditer(cell):
            if re.match(r"https?://[^/?#\s]", link := re.sub(r"(?i)&amp;", "&", found[1]).rstrip("),.;")):
                return link
    return None


def split_row(line: str) -> list[str]:
    """The cells of a table line; a backslash takes the next character as it is."""
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") else line
    parts = re.findall(r"((?:\\.|[^|\\])*)(?:\||\\?$)", line, re.DOTALL)
    cells = parts[:-1] if len(parts) > 1 and not line.endswith("|") and parts[-1] == "" else parts
    return [re.sub(r"\\(.)", r"\1", c, flags=re.DOTALL).strip() for c in cells]


def markdown_tables(text: str) -> Iterator[tuple[list[str], list[tuple[int, list[str]]]]]:
    lines, i = text.replace("\r", "").split("\n"), 0
    while i + 1 < len(lines):
        if "|" not in lines[i] or not _RULE.fullmatch(lines[i + 1]):
            i += 1
            continue
        names, end = split_row(lines[i]), i + 2
        while end < len(lines) and "|" in lines[end]:
            end += 1
        rows = [(k + 1, split_row(lines[k])) for k in range(i + 2, end)]
        yield names, [r for r in rows if len(r[1]) == len(names)]
        i = end


class _Tables(HTMLParser):
    """Tables with their cells' markup; a table in a cell is one of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.done: list[tuple[int, list]] = []
        self.open: list[dict] = []
        self.seen = 0

    def _put(self, markup: str) -> None:
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"].append(markup)

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._put(" ")
            self.open.append({"nth": self.seen, "rows": [], "cell": None})
            self.seen += 1
        elif self.open and tag == "tr":
            self._close_cell()
            self.open[-1]["rows"].append((self.getpos()[0], []))
        elif self.open and tag in ("td", "th") and self.open[-1]["rows"]:
            self._close_cell()
            self.open[-1]["cell"], self.open[-1]["head"] = [], tag == "th"
        else:
            self._put(self.get_starttag_text() or "")

    def handle_startendtag(self, tag, attrs):
        self._put(self.get_starttag_text() or "")

    def _close_cell(self) -> None:
        table = self.open[-1]
        if table["cell"] is not None:
            table["rows"][-1][1].append(("".join(table["cell"]).strip(), table["head"]))
            table["cell"] = None

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr", "table"):
            self._close_cell()
            if tag == "table":
                table = self.open.pop()
                self.done.append((table["nth"], table["rows"]))
        else:
            self._put(f"</{tag}>")

    def handle_data(self, data):
        self._put(data)

    def handle_entityref(self, name):
        self._put(f"&{name};")

    def handle_charref(self, name):
        self._put(f"&#{name};")


def html_tables(text: str) -> Iterator[tuple[list[str], list[tuple[int, list[str]]]]]:
    """Tables with a heading row: the first that has a heading cell; rows of as many cells follow it."""
    if not re.search(r"(?i)<table\b", text):
        return
    scanner = _Tables()
    scanner.feed(text)
    scanner.close()
    for _, rows in sorted(scanner.done, key=lambda t: t[0]):
        at = next((k for k, (_, cells) in enumerate(rows) if any(head for _, head in cells)), None)
        if at is None:
            continue
        names = [c for c, _ in rows[at][1]]
        yield names, [(n, [c for c, _ in cells]) for n, cells in rows[at + 1 :] if len(cells) == len(names)]


def table_postings(text: str) -> Iterator[dict]:
    """Postings of all tables that have columns for company, title and application, Markdown before HTML.

    An arrow in the place of a company repeats the one before, also from one table to the next.
    """
    company = ""
    for names, rows in (*markdown_tables(text), *html_tables(text)):
        heads = [plain(n).lower() for n in names]
        at = {k: next((i for i, h in enumerate(heads) if re.search(p, h)), None) for k, p in COLUMNS.items()}
        if None in (at["company"], at["title"], at["apply"]):
            continue
        for row, cells in rows:
            value = lambda k: plain(cells[at[k]]) if at[k] is not None else ""
            whole, named = " ".join(cells), value("company")
            company = named if named and not named.startswith("↳") else company
            link = first_link(cells[at["apply"]]) or first_link(cells[at["title"]])
            if (company if named else "") and value("title") and link:
                yield {"row": row, "company": company, "title": value("title"), "location": value("location") or "Unspecified", "apply_url": link, "pay": value("pay"), "posted": value("posted") or None, "closed": bool(CLOSED.search(whole)), "citizenship": bool(CITIZENSHIP.search(whole)), "degree": bool(DEGREE.search(whole))}


def role_title(code: str, label: str) -> str:
    base = ROLE_CODES.get(code.upper(), f"{code} Intern")
    special = re.sub(r"(?i)^apply$", "", re.sub("[✅❌]", "", plain(label))).strip()
    return f"{base} — {special}" if special else base


def section_postings(text: str) -> Iterator[dict]:
    """Postings of sections: a heading names the company, a line its locations, and table lines roles with links."""
    company, location = "", "Unspecified"
    for n, line in enumerate(text.replace("\r", "").split("\n"), 1):
        if heading := re.match(r"##\s+(.+?)\s*$", line):
            company, location = plain(heading[1]), "Unspecified"
        elif places := re.match(r"(?i)\*\*Locations\*\*:\s*(.+?)\s*$", line):
            location = plain(places[1]) or "Unspecified"
        elif company and (found := re.match(r"\|\s*([^|]+?)\s*\|\s*(.+?)\s*\|\s*$", line)):
            role, cell = plain(found[1]), found[2]
            if role.lower() == "role" or set(found[1].strip()) == {"-"}:
                continue
            whole = f"{found[1]} {cell}"
            for label, url in re.findall(rf"(?i)\[([^\]]*)\]\(({_URL})\)", cell):
                yield {"row": n, "company": company, "title": role_title(role, label), "location": location, "apply_url": re.sub(r"(?i)&amp;", "&", url), "pay": "", "posted": None, "closed": bool(CLOSED.search(whole)), "citizenship": "🇺🇸" in whole, "degree": "🎓" in whole}


LAYOUTS = {"tables": table_postings, "sections": section_postings}


def parse_lists(text: Column, layout: str = "tables") -> Column:
    """An array of the postings in a column of whole documents."""
    parse = LAYOUTS[layout]

    @F.pandas_udf(ArrayType(ROW))
    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: list(parse(x or "")))

    return parsed(text)


class _Reader(DataSourceReader):
    def __init__(self, path: str, layout: str):
        from pyarrow import fs

        self.layout = layout
        self.system, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        found = self.system.get_file_info(where)
        files = self.system.get_file_info(fs.FileSelector(where, recursive=True)) if found.type == fs.FileType.Directory else [found]
        self.files = sorted(f.path for f in files if f.type == fs.FileType.File)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with self.system.open_input_stream(partition.value) as f:
            text = f.read().decode("utf-8", "replace")
        for r in LAYOUTS[self.layout](text):
            yield (partition.value, *(r[n] for n in ROW.names))


class PostingLists(DataSource):
    """``spark.read.format("posting_lists").option("layout", ...).load(path)``: a task for each document."""

    @classmethod
    def name(cls) -> str:
        return "posting_lists"

    def schema(self) -> StructType:
        return StructType([StructField("document", StringType()), *ROW.fields])

    def reader(self, schema: StructType) -> DataSourceReader:
        layout = self.options.get("layout", "tables")
        if layout not in LAYOUTS:
            raise ValueError(f"layout must be one of {', '.join(LAYOUTS)}")
        return _Reader(self.options["path"], layout)


def snapshot_hash(rows: DataFrame, source: str, key: str, *fields: str, fan: int = 4096) -> DataFrame:
    """(source, content_hash): the same for the same rows in any order.

    Digests are sorted by key within ``fan`` ranges of the key's hash, and the ranges' hashes in turn, so
    that a task holds a range of a source and not all of it. It is not the hash of the sorted rows in one go.
    """
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in (key, *fields))), 256)
    ranges = rows.select(source, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(fan)).alias("part"), digest.alias("digest")).groupBy(source, "part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256).alias("digest"))
    return ranges.groupBy(source).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), ""), 256).alias("content_hash"))


def to_resolve(rows: DataFrame, hashes: DataFrame, checkpoints: DataFrame, source: str) -> DataFrame:
    """The rows of sources whose content hash is not that of their checkpoint: all other sources are skipped."""
    same = hashes.join(checkpoints.select(source, "content_hash"), [source, "content_hash"], "left_semi").select(source)
    return rows.join(same, source, "left_anti")
