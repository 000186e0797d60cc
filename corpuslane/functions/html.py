"""HTML trees as node tables, and what is read off them: links, meta data, visibility, regions, records, tables.

Parsing is the one step that needs Python (the standard library's tolerant parser, page by page in Arrow batches);
everything after it works on the node table with DataFrame functions.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: A start tag of the key closes an open element of the values.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "div": {"p"}, "ul": {"p"}, "table": {"p"}, "h1": {"p"}, "h2": {"p"}, "h3": {"p"}}
#: Font size in points and importance that a tag brings.
SIZES = {"h1": 32.0, "h2": 24.0, "h3": 18.7, "h4": 16.0, "h5": 13.3, "h6": 10.7, "small": 13.0, "big": 19.0}
HEADERS = ("h1", "h2", "h3")
BASE_SIZE = 16.0
NODE_SCHEMA = "node_id int, parent_id int, depth int, tag string, text string, attrs map<string,string>, visibility double"
COLORS = {"black": "000000", "white": "ffffff", "red": "ff0000", "green": "008000", "blue": "0000ff", "gray": "808080", "silver": "c0c0c0", "yellow": "ffff00", "navy": "000080", "maroon": "800000", "orange": "ffa500", "purple": "800080", "teal": "008080", "lime": "00ff00", "aqua": "00ffff", "fuchsia": "ff00ff", "olive": "808000"}


class Node:
    __slots__ = ("attrs", "children", "depth", "id", "parent", "style", "tag", "text")

    def __init__(self, id_: int, parent: Node | None, tag: str, attrs: dict[str, str]):
        self.id, self.parent, self.tag, self.attrs = id_, parent, tag, attrs
        self.depth = parent.depth + 1 if parent else 0
        self.text: list[str] = []
        self.children: list[Node] = []
        self.style: dict[str, str] = {}


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.open: list[Node] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        for closed in CLOSES.get(tag, ()):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].tag == closed:
                    del self.open[k:]
                    break
                if self.open[k].tag in ("table", "ul", "ol", "div", "body", "article"):
                    break
        node = Node(len(self.nodes), self.open[-1] if self.open else None, tag, {k: v or "" for k, v in attrs})
        if node.parent:
            node.parent.children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[-1].text.append(data)


def parse(source: str | None) -> list[Node]:
    """Nodes in document order; never fails on broken markup."""
    tree = _Tree()
    tree.feed(source or "")
    tree.close()
    return tree.nodes


def css_rules(source: str) -> list[tuple[str, dict[str, str]]]:
    """(selector, properties) of a style sheet in order; comments and at-rules are passed over."""
    source = re.sub(r"/\*.*?\*/", "", source, flags=re.S)
    rules = []
    for selectors, body in re.findall(r"([^{}@]+)\{([^{}]*)\}", source):
        props = {k.strip().lower(): v.strip() for k, _, v in (d.partition(":") for d in body.split(";")) if v.strip()}
        rules += [(s.strip(), props) for s in selectors.split(",") if s.strip()]
    return rules


def color_rgb(value: str | None) -> tuple[int, int, int] | None:
    """RGB of a colour name, #rgb, #rrggbb or rgb(); None if it is none of them."""
    if not value:
        return None
    v = COLORS.get(value.strip().lower(), value.strip().lower().lstrip("#"))
    if m := re.fullmatch(r"rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)", v):
        return tuple(min(255, int(x)) for x in m.groups())
    if re.fullmatch(r"[0-9a-f]{3}", v):
        v = "".join(c * 2 for c in v)
    return tuple(int(v[i : i + 2], 16) for i in (0, 2, 4)) if re.fullmatch(r"[0-9a-f]{6}", v) else None


def color_visibility(rgb: tuple[int, int, int] | None) -> float:
    """1.0 for dark text or none given, more for a strong colour, less for a pale one."""
    if rgb is None:
        return 1.0
    high, low = max(rgb), min(rgb)
    if high - low > 96:
        return 1.3
    return 1.0 if high < 128 else 0.8 if high < 224 else 1.0 if high == low == 255 else 0.6


def size_points(value: str | None, parent: float) -> float:
    m = re.fullmatch(r"([0-9.]+)\s*(px|pt|em|rem|%)?", (value or "").strip().lower())
    if not m or not re.fullmatch(r"[0-9]+(\.[0-9]+)?", m[1]):
        return {"small": 13.0, "medium": 16.0, "large": 18.0, "x-large": 24.0}.get((value or "").lower(), parent)
    n = float(m[1])
    return {"px": n, "pt": n * 4 / 3, "em": n * parent, "rem": n * BASE_SIZE, "%": n * parent / 100, None: n}[m[2]]


def visibilities(nodes: list[Node]) -> list[float]:
    """(weight / 500)^1.8 x variant x (size / 16)^3 x decoration x style x colour x importance of every node.

    Properties come from the tag, then rules for its tag, class and id in turn; what isn't set is inherited, and
    importance multiplies down the tree up to 2.
    """
    rules: dict[str, dict[str, str]] = {}
    for n in nodes:
        if n.tag == "style":
            for selector, props in css_rules("".join(n.text)):
                rules.setdefault(selector, {}).update(props)
    state: list[tuple] = []
    out = []
    for n in nodes:
        weight, variant, size, deco, style, color, importance = state[n.parent.id] if n.parent else (500.0, 1.0, BASE_SIZE, 1.0, 1.0, None, 1.0)
        if n.tag in ("b", "strong", "th", *SIZES) and n.tag not in ("small", "big"):
            weight = 700.0
        size = SIZES.get(n.tag, size)
        style = 1.1 if n.tag in ("i", "em") else style
        deco = 1.1 if n.tag == "u" else deco
        importance = min(2.0, importance * (1.2 if n.tag in ("title", "h1") else 1.0))
        props: dict[str, str] = {}
        for selector in (n.tag, *(f".{c}" for c in n.attrs.get("class", "").split()), *(f"#{i}" for i in [n.attrs.get("id")] if i)):
            props.update(rules.get(selector, {}))
        for k, _, v in (d.partition(":") for d in n.attrs.get("style", "").split(";")):
            if v.strip():
                props[k.strip().lower()] = v.strip()
        if "font-weight" in props:
            weight = {"bold": 700.0, "normal": 500.0}.get(props["font-weight"].lower(), float(props["font-weight"]) if props["font-weight"].isdigit() else weight)
        size = size_points(props.get("font-size"), size)
        variant = 1.2 if props.get("text-transform", "") == "uppercase" or props.get("font-variant", "") == "small-caps" else variant
        style = 1.1 if props.get("font-style", "") == "italic" else style
        deco = 1.1 if "underline" in props.get("text-decoration", "") else deco
        color = props.get("color", color)
        n.style = props
        state.append((weight, variant, size, deco, style, color, importance))
        out.append((weight / 500) ** 1.8 * variant * (size / BASE_SIZE) ** 3 * deco * style * color_visibility(color_rgb(color)) * importance)
    return out


def node_table(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """(key, node_id, parent_id, depth, tag, text, attrs, visibility) in document order; own text, blanks collapsed."""
    data = pages.select(F.col(key), F.col(source))
    key_type = data.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                keys, rows = [], []
                for k, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    nodes = parse(s)
                    for n, v in zip(nodes, visibilities(nodes)):
                        keys.append(k)
                        text = "" if n.tag in ("script", "style") else " ".join("".join(n.text).split())
                        rows.append((n.id, n.parent.id if n.parent else None, n.depth, n.tag, text, list(n.attrs.items()), round(v, 9)))
                columns = list(zip(*rows)) if rows else [[]] * 7
                types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, part.column(0).type), *[pa.array(c, t) for c, t in zip(columns, types)]], names=[key, "node_id", "parent_id", "depth", "tag", "text", "attrs", "visibility"])

    return data.mapInArrow(run, f"{key} {key_type}, {NODE_SCHEMA}")


def per_page(pages: DataFrame, f, schema: str, key: str = "page_id", source: str = "html") -> DataFrame:
    """Rows that f(nodes) gives for each page, after its key; schema lists f's columns."""
    data = pages.select(F.col(key), F.col(source))
    full = f"{key} {data.schema[key].dataType.simpleString()}, {schema}"
    types = to_arrow_schema(StructType.fromDDL(full))

    def run(batches):
        for batch in batches:
            rows = [(k, *r) for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in f(parse(s))]
            columns = list(zip(*rows)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, types)], schema=types)

    return data.mapInArrow(run, full)


def full_text(n: Node) -> str:
    parts: list[str] = []

    def walk(x: Node) -> None:
        parts.extend(x.text)
        for c in x.children:
            walk(c)

    walk(n)
    return " ".join("".join(parts).split())


# ---- columns over raw html


def clean(c: Column) -> Column:
    """Tags to blanks, white space and no-break spaces collapsed, outer blanks, quotes and brackets trimmed."""
    x = F.regexp_replace(c, "<[^>]*>", " ")
    return F.btrim(F.regexp_replace(x, "[ \t\n\r\f ]+", " "), F.lit(" \"'()"))


@F.pandas_udf(StringType())
def decoded(s):
    """Named and numeric entities as characters."""
    return s.map(lambda x: entities.unescape(x) if x is not None else None)


@F.pandas_udf(StringType())
def text_format(s):
    """Entities decoded, compatibility forms decomposed, white space collapsed."""
    return s.map(lambda x: " ".join(unicodedata.normalize("NFKD", entities.unescape(x)).split()) if x is not None else None)


# ---- the node table


def absolute(base: Column, href: Column) -> Column:
    """href against the address of its page."""
    origin, folder = F.regexp_extract(base, "^([a-z]+://[^/?#]+)", 1), F.regexp_extract(base, "^([a-z]+://[^?#]*/)", 1)
    page = F.regexp_extract(base, "^([^?#]*)", 1)
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.rlike("^[?#]"), F.concat(page, href))
        .otherwise(F.concat(F.when(F.length(folder) > F.length(origin) + 2, folder).otherwise(F.concat(origin, F.lit("/"))), href))
    )


def links(nodes: DataFrame, pages: DataFrame, pattern: str = "", key: str = "page_id") -> DataFrame:
    """Distinct (key, url, text) of anchors whose text and attributes together match pattern."""
    a = nodes.filter((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull())
    hay = F.concat_ws(" ", "text", F.concat_ws(" ", F.map_values("attrs")))
    hit = a.filter(hay.rlike(pattern)) if pattern else a
    return hit.join(pages.select(key, F.col("url").alias("__base")), key).select(key, absolute(F.col("__base"), F.col("attrs")["href"]).alias("url"), "text").distinct()


def pager_links(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    return nodes.filter((F.col("tag") == "a") & F.col("text").rlike("(?i)^ ?[0-9]+ ?$|next")).select(key, F.col("attrs")["href"].alias("href"), "text")


def header_count(nodes: DataFrame, pattern: str, key: str = "page_id") -> DataFrame:
    return nodes.filter(F.col("tag").isin(*HEADERS) & F.col("text").rlike(pattern)).groupBy(key).agg(F.count_distinct("text").alias("n"))


def frames(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    return nodes.filter(F.col("tag").isin("frame", "iframe") & F.col("attrs")["src"].isNotNull()).select(key, F.col("attrs")["src"].alias("src"))


def meta(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, name, values): meta data by name, a prefix like `DC.` or `og:` dropped, camel case split, keywords cut."""
    m = nodes.filter("tag = 'meta'")
    raw = F.coalesce(F.col("attrs")["name"], F.col("attrs")["http-equiv"], F.col("attrs")["property"], F.when(F.col("attrs")["charset"].isNotNull(), "charset"))
    name = F.lower(F.regexp_replace(F.regexp_replace(raw, "^[A-Za-z]+[.:]", ""), "([a-z])([A-Z])", "$1 $2"))
    value = F.coalesce(F.col("attrs")["content"], F.col("attrs")["charset"])
    values = F.when(name == "keywords", F.transform(F.split(value, ","), lambda v: F.trim(v))).otherwise(F.array(value))
    return m.select(key, name.alias("name"), F.explode(values).alias("v")).filter("name is not null and v <> ''").groupBy(key, "name").agg(F.sort_array(F.collect_set("v")).alias("values"))


def most_frequent(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """The most frequent (tag, depth) of each page, form parts and breaks aside; ties by tag, depth."""
    counts = nodes.filter(~F.col("tag").isin("option", "br", "select", "form")).groupBy(key, "tag", "depth").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "tag", "depth")).alias("b")).select(key, F.col("b.tag").alias("tag"), F.col("b.depth").alias("depth"), (-F.col("b.m")).alias("n"))


def regions(nodes: DataFrame, header: float = 4.0, least_text: int = 10, key: str = "page_id") -> DataFrame:
    """(key, region, header, records): a node of visibility >= header opens a region of the texts that follow."""
    body = nodes.filter("tag not in ('script', 'style', 'title', 'head', 'html')")
    w = Window.partitionBy(key).orderBy("node_id")
    marked = body.withColumn("h", (F.col("visibility") >= header) & (F.col("text") != "")).withColumn("region", F.sum(F.col("h").cast("int")).over(w))
    names = marked.filter("h").groupBy(key, "region").agg(F.first("text").alias("header"))
    records = marked.filter(~F.col("h") & (F.length("text") > least_text)).groupBy(key, "region").agg(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "text"))), lambda s: s["text"]).alias("records"))
    return names.join(records, [key, "region"], "full").select(key, "region", "header", F.coalesce("records", F.array().cast("array<string>")).alias("records"))


#: Visibilities that may open a region, when the best one is sought.
LEVELS = tuple(8.0 - 0.5 * i for i in range(14))


def best_header(nodes: DataFrame, levels: tuple[float, ...] = LEVELS, least_text: int = 10, key: str = "page_id") -> DataFrame:
    """(key, header): of levels the one whose regions() hold most nearly e texts each, the smallest of equals; one pass over the nodes."""
    body = nodes.filter("tag not in ('script', 'style', 'title', 'head', 'html')").select(key, "node_id", "visibility", "text", F.explode(F.array(*[F.lit(x) for x in levels])).alias("header"))
    opens = (F.col("visibility") >= F.col("header")) & (F.col("text") != "")
    holds = ~opens & (F.length("text") > least_text)
    first = lambda c: F.min(F.when(c, F.col("node_id")))
    each = body.groupBy(key, "header").agg(F.count_if(opens).alias("opened"), F.count_if(holds).alias("records"), first(opens).alias("o"), first(holds).alias("r"))
    # texts before the first header are a region as well
    regions = F.col("opened") + F.when(F.col("r") < F.coalesce("o", F.col("r") + 1), 1).otherwise(0)
    fair = F.round(F.abs(F.log((F.col("records") + 1) / (regions + 1)) - 1), 9)
    return each.filter(regions > 0).groupBy(key).agg(F.min_by("header", F.struct(fair, "header")).alias("header"))


def chunks(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, record, chunks): text-bearing nodes under each child of the body's blocks, with link, title and tag."""
    up = nodes.select(key, F.col("node_id").alias("parent_id"), F.col("tag").alias("parent_tag"))
    each = nodes.filter("text <> '' and tag not in ('script', 'style')").join(up, [key, "parent_id"])
    return each.groupBy(key, F.col("parent_id").alias("record")).agg(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "text", F.col("attrs")["href"].alias("link"), F.col("attrs")["title"].alias("title"), "tag"))), lambda s: s.dropFields("node_id")).alias("chunks"))


def table_rows(nodes: list[Node]) -> list[tuple[int, str | None, list[str], bool]]:
    """(row, first link, cell texts, is header) of every table row; a row of th cells or header words is a header."""
    words = {"title", "name", "number", "no", "date", "author", "authors", "type", "status", "description", "file"}
    out = []
    for n in nodes:
        if n.tag == "tr":
            cells = [c for c in n.children if c.tag in ("td", "th")]
            texts = [full_text(c) for c in cells]
            link = next((x.attrs.get("href") for c in cells for x in walk(c) if x.tag == "a"), None)
            head = bool(cells) and (all(c.tag == "th" for c in cells) or sum(t.lower() in words for t in texts) * 2 > len(texts))
            out.append((n.id, link, texts, head))
    return out


def walk(n: Node):
    yield n
    for c in n.children:
        yield from walk(c)


def common_parent(nodes: list[Node], members: list[Node], tolerance: int = 0) -> Node | None:
    """The deepest level at which members have at most tolerance + 1 distinct ancestors; its most frequent one."""
    paths = []
    for m in members:
        path, x = [], m.parent
        while x:
            path.append(x.id)
            x = x.parent
        paths.append(path[::-1])
    best = None
    for level in range(min(map(len, paths), default=0)):
        at = [p[level] for p in paths]
        if len(set(at)) <= tolerance + 1:
            best = max(sorted(set(at)), key=at.count)
    return nodes[best] if best is not None else None


def menu(nodes: list[Node], words: tuple[str, ...] = ("home", "about", "contact", "news", "publications", "members", "partners", "links", "downloads", "results", "events", "login", "search", "sitemap", "the", "and")) -> list[tuple[str, str]]:
    """(text, href) of the links under the common parent of anchors with menu words; none where it has long texts."""
    anchors = [n for n in nodes if n.tag == "a" and full_text(n).lower() in words]
    parent = common_parent(nodes, anchors, 0) if len(anchors) > 1 else None
    if parent is None:
        return []
    found = [x for x in walk(parent) if x.tag == "a"]
    return [] if any(len(full_text(x)) > 50 for x in found) else [(full_text(x), x.attrs.get("href", "")) for x in found]


def sift(nodes: list[Node], coefficient: float = 2.0) -> list[tuple[int, str, str]]:
    """Records of a page: the most frequent (tag, depth) climbs to its parents while they hold few elements each."""

    kinds = Counter((n.tag, n.depth) for n in nodes if n.tag not in ("option", "br", "select", "form"))
    if not kinds:
        return []
    kind = min(kinds, key=lambda k: (-kinds[k], k))
    members = [n for n in nodes if (n.tag, n.depth) == kind]
    while True:
        parents = list({n.parent.id: n.parent for n in members if n.parent}.values())
        if not parents or parents[0].tag in ("body", "html") or len(members) >= coefficient * len(parents):
            break
        members = parents
    return [(n.id, n.tag, full_text(n)) for n in members]


def below_headers(nodes: DataFrame, header: float = 4.0) -> DataFrame:
    """The regions of pages that stand below a header."""
    return regions(nodes, header).filter("header is not null")


def link_path(ns: list[Node]) -> list[tuple[str]]:
    """The most frequent chain of three tags down to a link, ties by name; for per_page."""
    found = Counter(">".join(x.tag for x in (n.parent.parent, n.parent, n)) for n in ns if n.tag == "a" and n.parent and n.parent.parent)
    return [(min(found, key=lambda c: (-found[c], c)),)] if found else []
