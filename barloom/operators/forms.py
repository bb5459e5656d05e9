"""Fields, tables and narrative sections of regulatory forms in HTML.

A table function turns a page into rows in order of the page: texts, cells, blocks, marks. Everything else is relational: a
label's value is the next cell behind its first text, a section is the range of siblings between a heading and the next one that is
not below it. A page is parsed in one pass with the standard library; its rows are spread like any others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Elements without an end, elements that aren't text, elements that are no content, blocks that may head or make a section.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CODE = {"script", "style"}
ASIDE = {"script", "style", "nav", "header", "footer"}
BLOCKS = {"h1", "h2", "h3", "h4", "div", "p", "span", "font", "b", "strong"}
PART = "place int, kind string, name string, classes array<string>, text string, bare string, parent int, grid int, line int"


class _Page(HTMLParser):
    """Rows of a page. A tag without an end nests what follows until its parent ends, as lenient readers have it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.place, self.rows, self.open = 0, [], []
        self.marked: list[list] = []  # checked boxes that wait for their label

    def _next(self) -> int:
        self.place += 1
        return self.place

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found = dict(attrs)
        classes, place = (found.get("class") or "").split(), self._next()
        if tag == "input" and (found.get("type") or "").lower() == "checkbox" and "checked" in found:
            group = next((e["place"] for e in reversed(self.open) if e["tag"] == "div" and e["classes"]), 0)
            row = [place, "mark", tag, classes, "", "", group, 0, 0]
            self.rows.append(row)
            self.marked.append(row)
        if tag in VOID:
            return
        grid = next((e for e in reversed(self.open) if e["tag"] == "table"), None)
        if tag == "tr" and grid is not None:
            grid["lines"] += 1
        aside = tag in ASIDE or bool(self.open and self.open[-1]["aside"])
        self.open.append({"tag": tag, "classes": classes, "place": place, "parts": [], "name": found.get("name") or "", "grid": grid, "lines": 0, "line": grid["lines"] if grid else 0, "aside": aside, "parent": self.open[-1]["place"] if self.open else 0})

    def handle_endtag(self, tag: str) -> None:
        if any(e["tag"] == tag for e in self.open):
            while self._close()["tag"] != tag:
                pass

    def _close(self) -> dict:
        e = self.open.pop()
        tag = e["tag"]
        text = "".join(e["parts"])
        if self.open:
            self.open[-1]["parts"].extend(e["parts"])
        bare = "".join(p.strip() for p in e["parts"])
        if tag == "label":
            for row in [m for m in self.marked if m[0] < e["place"]]:
                row[4] = text.strip()
                self.marked.remove(row)
        kind = "cell" if tag == "td" else "fact" if tag == "xbrl:tag" else "entity" if tag == "ix:nonnumeric" else "block" if tag in BLOCKS and not e["aside"] else None
        if kind:
            grid = e["grid"]
            name = tag if kind in ("cell", "block") else e["name"]
            classes = e["classes"] if kind != "cell" else e["classes"] + [f"in {c}" for c in (grid["classes"] if grid else [])]
            self.rows.append([e["place"], kind, name, classes, text.strip(), bare, e["parent"], grid["place"] if grid else 0, e["line"]])
        return e

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["tag"] in CODE:
            return
        place = self._next()
        if self.open:
            self.open[-1]["parts"].append(data)
        if data.strip():
            self.rows.append([place, "text", "", [], data, "", 0, 0, 0])

    def finish(self) -> list[list]:
        self.close()
        while self.open:
            self._close()
        return self.rows


class PageParts:
    """Table function: HTML -> its parts."""

    def eval(self, html: str | None) -> Iterator[tuple]:
        if html:
            page = _Page()
            page.feed(html)
            yield from map(tuple, page.finish())


class PageBlocks:
    """Table function: HTML -> its blocks and entities alone, without what only fields and tables need."""

    def eval(self, html: str | None) -> Iterator[tuple]:
        if html:
            page = _Page()
            page.feed(html)
            for place, kind, name, _, _, bare, parent, _, _ in page.finish():
                if kind in ("block", "entity"):
                    yield place, kind, name, bare, parent


def parts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with their other columns, a row for each part; pages without parts have none."""
    function = F.udtf(PageParts, returnType=PART)
    rest = [c for c in pages.columns if c != html]
    return pages.lateralJoin(function(F.col(html).outer())).select(*rest, *[c.split()[0] for c in PART.split(", ")])


#: What each form has. Labels of values and of longer texts; columns of its table; its groups, by class, with their labels; labels that make its narrative.
DATA, TEXT = "FormData", "FormText"
FORMS = {
    "25": {"data": {"issuer": "Issuer:", "exchange": "Exchange:", "address": "Address:", "date": "Date:", "securities_removed": "Securities:", "rule_provisions": "Rule:", "signatory": "By:"}},
    "4": {
        "data": {"reporting_person": "Reporting Person:", "issuer": "Issuer:", "title": "Title:", "ownership_type": "Ownership Type:", "transaction_date": "Transaction Date:", "transaction_type": "Transaction Type:", "amount": "Amount:", "price": "Price:", "officer_role": "Officer Role:"},
        "table": ("security", "transaction_type", "amount", "price"),
    },
    "8-K": {
        "data": {"registrant": "Registrant:", "filing_date": "Filing Date:", "commission_file": "Commission File:", "state": "State:", "address": "Address:"},
        "group": "FormGroup", "group_data": {"date": "Event Date:"}, "group_text": {"description": "Event Description:"}, "group_narrative": ("Event Description:",),
    },
    "10-K": {
        "data": {"registrant": "Registrant:", "filing_date": "Filing Date:", "period": "Period:"}, "text": {"business_overview": "Business Overview:", "risk_factors": "Risk Factors:"},
        "narrative": ("Business Overview:", "Risk Factors:", "Management Discussion:", "Financial Discussion:"),
    },
    "10-Q": {
        "data": {"registrant": "Registrant:", "filing_date": "Filing Date:", "period": "Period:"}, "text": {"company_info": "Company Information:", "financial_discussion": "Financial Discussion:"},
        "narrative": ("Company Information:", "Financial Discussion:", "Management Discussion:"),
    },
    "144": {
        "data": {"issuer": "Issuer:", "insider_name": "Reporting Person:", "securities_sold": "Securities:", "amount": "Amount:", "price": "Price:", "date": "Date:", "ownership": "Ownership:", "broker": "Broker:", "broker_address": "Broker Address:"},
        "table": ("security_type", "amount", "ownership_type"),
    },
    "DEF 14A": {
        "data": {"registrant": "Registrant:", "filing_date": "Filing Date:", "meeting_date": "Meeting Date:", "meeting_type": "Meeting Type:"},
        "group": "DirectorInfo", "group_data": {"name": "Name:", "age": "Age:"}, "group_text": {"biography": "Biography:", "compensation": "Compensation:"}, "group_narrative": ("Biography:", "Compensation:"),
        "second": "VotingMatter", "second_narrative": ("Description:", "Recommendation:"),
    },
    "SD": {
        "data": {"registrant": "Registrant:", "filing_date": "Filing Date:"}, "text": {"due_diligence": "Due Diligence:", "declaration": "Declaration:"}, "narrative": ("Due Diligence:", "Declaration:"),
        "group": "CountryInfo", "group_data": {"name": "Country:"}, "group_text": {"minerals": "Minerals:", "smelters": "Smelters:"}, "group_narrative": ("Minerals:", "Smelters:"),
    },
    "11-K": {
        "data": {"plan_name": "Plan Name:", "registrant": "Registrant:", "filing_date": "Filing Date:", "auditor": "Auditor:"}, "narrative": ("Auditor Report:",),
        "group": "FinancialStatement", "group_data": {"type": "Statement Type:", "period": "Period:"}, "group_text": {"content": "Content:"}, "group_narrative": ("Content:",),
    },
}


def label_values(found: DataFrame, key: str, form: str, wanted: list[tuple[str, str, str, str]]) -> DataFrame:
    """Parts and (form, field, label, class) -> (key, field, value): the first text with the label, then the next cell of the class."""
    table = F.array(*[F.struct(F.lit(f).alias("form"), F.lit(n).alias("field"), F.lit(x).alias("label"), F.lit(c).alias("class")) for f, n, x, c in wanted])
    mine = F.filter(table, lambda w: (w["form"] == F.col(form)) & F.contains(F.col("text"), w["label"]))
    starts = found.where("kind = 'text'").select(key, "place", F.explode(mine).alias("w")).groupBy(key, F.col("w.field").alias("field"), F.col("w.class").alias("class")).agg(F.min("place").alias("_from"))
    cells = found.where("kind = 'cell'").select(key, "place", "text", F.explode("classes").alias("class"))
    met = starts.join(cells, [key, "class"]).where(F.col("place") > F.col("_from"))
    return met.groupBy(key, "field").agg(F.min_by("text", "place").alias("value"))


def _wanted() -> list[tuple[str, str, str, str]]:
    out = []
    for form, has in FORMS.items():
        for prefix, names, css in (("", "data", DATA), ("", "text", TEXT), ("group.", "group_data", DATA), ("group.", "group_text", TEXT)):
            out += [(form, prefix + field, label, css) for field, label in has.get(names, {}).items()]
        out += [(form, f"told.{label}", label, TEXT) for part in ("narrative", "group_narrative", "second_narrative") for label in has.get(part, ())]
    return sorted(set(out))


def parse_forms(pages: DataFrame, key: str, form: str = "form", html: str = "html") -> DataFrame:
    """(key, form, html) -> one row a page: fields (map), lines (array of maps, of the table), groups (how many, fields that they share,
    disclosures of each), statements (map of tagged facts), narrative (what sentiment reads).

    A field whose label or cell is missing is ''. Forms that aren't listed have no fields. A page without any part keeps its row.
    """
    base = pages.select(key, F.col(form).alias("form"))
    found = parts(pages.select(key, F.col(form).alias("form"), html), html)
    values = label_values(found, key, "form", _wanted()).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_v"))
    # The first table of the class; its first line is a header.
    cells = found.where("kind = 'cell' AND line > 0 AND grid > 0").where(F.array_contains("classes", f"in {DATA}"))
    first = cells.groupBy(key).agg(F.min("grid").alias("grid"))
    lines = cells.join(first, [key, "grid"]).where("line > 1").groupBy(key, "form", "line").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("_c"))
    columns = lambda f: F.array(*[F.lit(c) for c in FORMS[f]["table"]])
    names = F.lit(None).cast("array<string>")
    for f in FORMS:
        if "table" in FORMS[f]:
            names = F.when(F.col("form") == f, columns(f)).otherwise(names)
    lines = lines.withColumn("_n", names).where(F.size("_c") >= F.size("_n")).where("_n IS NOT NULL")
    lines = lines.select(key, "line", F.map_from_arrays("_n", F.transform(F.slice("_c", 1, F.size("_n")), lambda c: c["text"])).alias("m"))
    lines = lines.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", F.map_entries("m").alias("e")))), lambda x: F.map_from_entries(x["e"])).alias("lines"))
    group_of = lambda part: F.coalesce(*[F.when(F.col("form") == f, F.lit(has[part])) for f, has in FORMS.items() if part in has])
    groups = found.where("kind = 'block' AND name = 'div'").where(F.array_contains("classes", group_of("group")) | F.array_contains("classes", group_of("second")))
    groups = groups.select(key, "place", F.array_contains("classes", group_of("group")).alias("_main"))
    marks = found.where("kind = 'mark'").select(key, F.col("parent").alias("place"), F.col("place").alias("_at"), F.col("text").alias("_label"))
    told = groups.join(marks, [key, "place"], "left").groupBy(key, "place", "_main").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_label").isNotNull(), F.struct("_at", "_label")))), lambda m: m["_label"]).alias("d"))
    told = told.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_main"), F.struct("place", "d")))), lambda g: g["d"]).alias("_groups"), F.count_if(~F.col("_main")).cast("int").alias("_second"))
    facts = found.where("kind = 'fact' AND name <> '' AND text <> ''").where(F.col("form").isin("10-K", "10-Q"))
    facts = facts.groupBy(key, "name").agg(F.max_by("text", "place").alias("text")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("statements"))
    out = base
    for part in (values, lines, told, facts):
        out = out.join(part, key, "left")
    v = F.coalesce("_v", F.create_map().cast("map<string,string>"))
    get = lambda name: F.coalesce(F.try_element_at(v, F.lit(name)), F.lit(""))
    many, second = F.size(F.coalesce("_groups", F.array().cast("array<array<string>>"))), F.coalesce("_second", F.lit(0))
    fields, shared, narrative = F.lit(None).cast("map<string,string>"), F.lit(None).cast("map<string,string>"), F.lit(None).cast("array<string>")
    made = lambda names, prefix: F.create_map(*[x for n in names for x in (F.lit(n), get(prefix + n))]) if names else F.create_map().cast("map<string,string>")
    none = F.array().cast("array<string>")
    for f, has in FORMS.items():
        own = F.col("form") == f
        fields = F.when(own, made([*has.get("data", {}), *has.get("text", {})], "")).otherwise(fields)
        shared = F.when(own, made([*has.get("group_data", {}), *has.get("group_text", {})], "group.")).otherwise(shared)
        texts = lambda part: F.array(*[get(f"told.{x}") for x in has.get(part, ())]) if has.get(part) else none  # noqa: B023, E731
        narrative = F.when(own, F.concat(texts("narrative"), F.flatten(F.array_repeat(texts("group_narrative"), many)), F.flatten(F.array_repeat(texts("second_narrative"), second)))).otherwise(narrative)
    return out.select(
        key, "form", F.coalesce(fields, F.create_map().cast("map<string,string>")).alias("fields"), F.coalesce("lines", F.array().cast("array<map<string,string>>")).alias("lines"), many.alias("groups"), F.when(many > 0, shared).alias("group_fields"),
        F.coalesce("_groups", F.array().cast("array<array<string>>")).alias("disclosures"), F.coalesce("statements", F.create_map().cast("map<string,string>")).alias("statements"),
        F.array_join(F.filter(F.coalesce(narrative, none), lambda t: t != ""), " ").alias("narrative"),
    )


#: Headings of sections that sentiment reads, phrases of boilerplate, words of business.
HEADINGS = (
    "Management's Discussion and Analysis", "MD&A", "Risk Factors", "Business Overview", "Business Description", "Legal Proceedings", "Forward-Looking Statements", "Results of Operations",
    "Financial Condition", "Liquidity and Capital Resources", "Critical Accounting Policies", "Market Risk", "Competition", "Item 1A", "Item 7", "Item 1",
)
BOILERPLATE = (
    "securities and exchange commission", "washington, d.c.", "united states", "commission file number", "exact name of registrant", "pursuant to section", "table of contents", "securities act of 1933",
    "exchange act of 1934", "incorporated by reference", "form 10-k", "form 10-q", "form 8-k", "proxy statement", "annual report", "quarterly report",
)
BUSINESS = (
    "revenue", "income", "profit", "loss", "earnings", "growth", "decline", "increase", "decrease", "performance", "results", "operations", "business", "market", "competition", "strategy", "outlook",
    "risk", "opportunity", "challenge", "financial", "customers", "sales", "products", "services", "management", "believe", "expect", "anticipate", "future", "prospects", "trends", "industry",
)
#: Lengths of a heading, of a part of a section, of a section's parts, of a section, of a general part and all of them, of the text of a page.
HEADING_CHARS, PART_CHARS, PARTS_CHARS, SECTION_CHARS, GENERAL_CHARS, GENERALS_CHARS, TEXT_CHARS = (5, 300), 100, 3000, 500, 300, 5000, 10_000


def _has(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-cased text has one of the words."""
    return reduce(or_, [F.contains(text, F.lit(w.lower())) for w in words])


def narrative(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, html) -> (key, sections, text): the sections behind known headings, and what sentiment reads: these, else general paragraphs, then the company's name.

    A section runs over a heading's siblings up to the next heading that isn't below it, and ends with the part that makes it
    long enough. Pages without any have an empty text.
    """
    function = F.udtf(PageBlocks, returnType="place int, kind string, name string, bare string, parent int")
    found = pages.select(key, html).lateralJoin(function(F.col(html).outer())).select(key, "place", "kind", "name", "bare", "parent")
    block, long = F.col("kind") == "block", F.length("bare")
    level = F.when(block & F.col("name").rlike("^h[1-4]$"), F.substring("name", 2, 1).cast("int"))
    # Only texts that may be a part or a heading are searched for words.
    maybe_part, maybe_head = block & F.col("name").isin("p", "div", "span", "font") & (long > PART_CHARS), block & (long < HEADING_CHARS[1]) & (long > HEADING_CHARS[0])
    found = found.withColumn("_low", F.when(maybe_part | maybe_head, F.lower("bare")))
    part = maybe_part & ~_has(F.col("_low"), BOILERPLATE) & _has(F.col("_low"), BUSINESS)
    heads = maybe_head & _has(F.col("_low"), HEADINGS)
    general = F.col("name").isin("p", "div") & (long > GENERAL_CHARS) & F.col("_part")
    entity = (F.col("kind") == "entity") & (F.contains("name", F.lit("EntityRegistrantName")) | F.contains("name", F.lit("EntityName"))) & (long > 5)
    found = found.withColumns({"_level": level, "_part": part, "_head": heads, "_entity": entity}).drop("_low").withColumn("_general", general)
    # Pages are parsed once for all that follows; the text of a block that is no part of the result isn't kept.
    found = found.where(block | F.col("_entity")).select(key, "parent", "place", "_level", "_part", "_head", "_general", "_entity", F.when(F.col("_part") | F.col("_general") | F.col("_entity"), F.col("bare")).alias("bare")).persist()
    rows = found.where("NOT _entity")
    w = W.partitionBy(key, "parent").orderBy("place")
    after = w.rowsBetween(1, W.unboundedFollowing)
    stops = {f"_stop{n}": F.min(F.when(F.col("_level") <= n, F.col("place"))).over(after) for n in range(1, 6)}
    rows = rows.withColumns({"_n": F.sum(F.col("_part").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)), **stops})
    own = F.coalesce("_level", F.lit(5))
    stop = F.coalesce(*[F.when(own == n, F.col(f"_stop{n}")) for n in range(1, 6)])
    # Parts are numbered among siblings; a section needs the next few of them, as each has PART_CHARS.
    section = rows.where("_head").select(key, "parent", F.col("place").alias("_at"), stop.alias("_stop"), F.explode(F.sequence(F.col("_n") + 1, F.col("_n") + PARTS_CHARS // PART_CHARS + 1)).alias("_n"))
    met = section.join(rows.where("_part").select(key, "parent", "_n", "place", "bare"), [key, "parent", "_n"]).where("_stop IS NULL OR place < _stop")
    before = W.partitionBy(key, "_at").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    joined = F.coalesce(F.sum(F.length("bare")).over(before) + F.count("*").over(before) - 1, F.lit(0))
    met = met.withColumn("_before", joined).where(F.col("_before") < PARTS_CHARS)
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "bare"))), lambda x: x["bare"]), " ")
    sections = met.groupBy(key, "_at").agg(content.alias("_s")).where(F.length("_s") > SECTION_CHARS)
    sections = sections.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_s"))), lambda x: x["_s"]).alias("sections"))
    sofar = W.partitionBy(key).orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    general = rows.where("_general").withColumn("_b", F.coalesce(F.sum(F.length("bare")).over(sofar) + F.count("*").over(sofar) - 1, F.lit(0))).where(F.col("_b") <= GENERALS_CHARS)
    general = general.groupBy(key).agg(content.alias("_general"))
    entity = found.where("_entity").groupBy(key).agg(F.concat(F.lit("Company: "), F.min_by("bare", "place")).alias("_company"))
    out = pages.select(key).join(sections, key, "left").join(general, key, "left").join(entity, key, "left")
    text = F.concat_ws(" ", F.coalesce(F.array_join("sections", " "), F.when(F.col("_general") != "", F.col("_general"))), "_company")
    return out.select(key, F.coalesce("sections", F.array().cast("array<string>")).alias("sections"), F.when(F.length(text) > TEXT_CHARS, F.concat(F.substring(text, 1, TEXT_CHARS), F.lit("..."))).otherwise(text).alias("text"))
