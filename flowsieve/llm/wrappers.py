"""Main text of web pages by wrappers inferred from pages of the same host.

Crescenzi et al., "RoadRunner" (2001).  A page becomes a token stream of block
tags and texts, nested as the tags close (also where closing tags are missing).
Groups of tokens that follow themselves are folded into repeated groups, so most
pages of a template have the same stream.  The distinct streams of a host are
aligned one after another into one union-free regular expression: what matches
is kept, a mismatch becomes an optional group or joins a repeated group next to
it, and differing texts become text slots.  Streams are aligned in chunks of
bounded size whose expressions are aligned again, so no task sees all pages of a
host.

Slots, not pages, are judged: by the elements around them, their share of links
and whether their text is the same on all pages of the host.  Every page's texts
are then kept or dropped by the slot they fall into.
"""

from __future__ import annotations

import html
import json
import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.bounded import materialise
from flowsieve.functions.shipping import ship_package
from flowsieve.llm.shared import small_or_shuffled
from flowsieve.llm.url_filter import host_of

# Streams aligned in one task; larger hosts take several rounds.
CHUNK = 64
# Elements nested deeper than this count as part of the one around them; their end tags end nothing else.
DEPTH = 60
# Longest group of siblings that may repeat.
GROUP = 6
# A text that is the same on so many distinct pages of a host, and on all that have its slot, belongs to the template.
SAME_PAGES = 5

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr br input label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
                   "pre section table ul figure details menu".split())
# Elements that an open one of the same family ends, and the elements that family ends at.
FAMILY = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
          "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
          "option": (("option",), ("select",)), "body": (("head",), ())}
# Elements and name parts of what stands around an article.
AROUND = frozenset("head nav footer header aside form button select noscript template iframe svg dialog menu object canvas "
                   "audio video script style title".split())
AROUND_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side|side-?bar|menu|nav|nav-?bar|navigation|bread-?crumbs?|footer|"
    r"header|masthead|top-?bar|comments?|comment-?list|commentary|disqus|repl(?:y|ies)|respond|share|sharing|social|cookies?|consent|gdpr|"
    r"notices?|alerts?|pop-?up|modal|overlay|newsletter|subscri\w+|related|recommend\w*|widgets?|pagination|pager|legal|"
    r"copyright|log-?in|sign-?up|search|toolbar|hidden|contentinfo|complementary|navigation|dialog)(?:$|[\s_-])", re.I)
# Elements that hold a text but no article.
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption caption".split())
# The same on an article itself.
ASIDE_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|repl(?:y|ies)|respond|related|teasers?|hidden)(?:$|[\s_-])", re.I)
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:main|content|story|article|article-?body|post-?(?:body|content)|entry-?content)(?:$|[\s_-])", re.I)

def _tokens(value: str) -> re.Pattern:
    """Comments, tags whose quoted values are ``value`` long, other tags up to the first >, and text."""
    return re.compile(
        r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
        rf"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]{value}\"|'[^']{value}')*+)>"
        r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|([^<]+)|<", re.S)


# Quoted values of any length.  Once a page has shown a quote without an end, the search for later ones' ends is bounded.
token_of, bounded_token_of = _tokens("*+"), _tokens("{0,65536}+")
attribute = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
spaces = re.compile(r"\s+")
digits = re.compile(r"\d+")


class Node:
    """An element (name with its class and id) or, with kids None, a text."""

    __slots__ = ("name", "kids", "key", "groups", "leaves", "text", "linked")

    def __init__(self, name: str, kids: list | None):
        self.name, self.kids = name, kids


def _signature(name: str, attributes: str) -> str:
    found = []
    for key, value in attribute.findall(attributes):
        key, value = key.lower(), value.strip("\"'").strip()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            found.append("hidden")
        elif key in ("class", "id", "role", "itemprop") and value:
            found.append(digits.sub("0", spaces.sub(" ", value)).lower())
    return f"{name} {' '.join(found)}" if found else name


def parse(page: str) -> Node:
    """Nested block elements and texts of a page; comments, scripts, styles and markup inside texts are gone."""
    root = Node("page", [])
    stack = [root]
    text: list[str] = []
    linked = in_link = at = 0
    size = len(page)
    token = token_of
    deep: dict[str, int] = {}

    def close_text() -> None:
        nonlocal linked
        if text:
            words = spaces.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if words:
                leaf = Node("#", None)
                leaf.text, leaf.linked = words, linked
                stack[-1].kids.append(leaf)
        linked = 0

    while at < size:
        match = token.match(page, at)
        at = match.end()
        run = match.group(7)
        if run is not None or match.group() == "<":
            text.append(match.group())
            linked += len(match.group()) * (in_link > 0)
            continue
        closing, name, rest = match.group(1), match.group(2), match.group(3)
        if name is None:
            closing, name, rest = match.group(4), match.group(5), match.group(6)
            if name is not None:
                token = bounded_token_of
        if name is None:
            continue
        name = name.lower()
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            elif name == "br":
                text.append(" ")
            continue
        close_text()
        if closing:
            if deep.get(name):
                deep[name] -= 1
            elif any(node.name.split(" ", 1)[0] == name for node in stack[1:]):
                while stack[-1].name.split(" ", 1)[0] != name:
                    stack.pop()
                stack.pop()
                deep.clear()
            continue
        in_link = 0 if name in ENDS_P else in_link
        if name in ENDS_P and stack[-1].name.split(" ", 1)[0] == "p":
            stack.pop()
        ended, limits = FAMILY.get(name, ((), ()))
        for depth in range(len(stack) - 1, 0, -1):
            tag = stack[depth].name.split(" ", 1)[0]
            if tag in limits:
                break
            if tag in ended:
                del stack[depth:]
                break
        if name in VOID:
            continue
        if len(stack) > DEPTH:
            deep[name] = deep.get(name, 0) + 1
            continue
        node = Node(_signature(name, rest) if rest else name, [])
        stack[-1].kids.append(node)
        stack.append(node)
    close_text()
    return root


def fold(node: Node) -> None:
    """Find each node's key, its repeated groups of kids and its number of distinct leaves.

    A group is a list of members with the same key; elements without any text are left out.
    """
    if node.kids is None:
        node.key, node.leaves = "#", 1
        return
    for kid in node.kids:
        fold(kid)
    groups = [[kid] for kid in node.kids if kid.leaves]
    for length in range(1, GROUP + 1):
        folded, at = [], 0
        while at < len(groups):
            keys = [g[0].key for g in groups[at:at + length]]
            end = at + length
            while len(keys) == length and [g[0].key for g in groups[end:end + length]] == keys:
                end += length
            if end == at + length:
                folded.append(groups[at])
                at += 1
                continue
            if length == 1:
                folded.append([member for g in groups[at:end] for member in g])
            else:
                folded.append([_grouped(groups[i:i + length]) for i in range(at, end, length)])
            at = end
        groups = folded
    node.groups = groups
    _finish(node)


def _grouped(groups: list[list[Node]]) -> Node:
    """Several siblings that repeat together, as one node without a name."""
    node = Node("()", [])
    node.groups = groups
    _finish(node)
    return node


def _finish(node: Node) -> None:
    node.leaves = sum(members[0].leaves for members in node.groups)
    node.key = f"{node.name}({' '.join(members[0].key for members in node.groups)})"


def shape(node: Node) -> list:
    """The folded stream as nested lists [name, kids, optional, repeated]; a text is named #."""
    kids = []
    for members in node.groups if node.kids is not None else ():
        one = shape(members[0])
        one[3] = int(len(members) > 1)
        kids.append(one)
    return [node.name, kids, 0, 0]


def leaves_of(node: Node, base: int = 0):
    """(text, linked characters, number of its leaf in the folded stream) in page order."""
    if node.kids is None:
        yield node.text, node.linked, base
        return
    for members in node.groups:
        for member in members:
            yield from leaves_of(member, base)
        base += members[0].leaves


def _longest_common(left: list, right: list) -> list[tuple[int | None, int | None]]:
    """A longest common subsequence of two lists as pairs, with what has no partner beside None.

    Rows of the table of lengths are bits of an integer (Crochemore et al., "A fast and practical bit-vector algorithm
    for the longest common subsequence problem", 2001): the zeros among the lowest m - j bits of row i count what
    left[i:] and right[j:] have in common.  Rows are kept at every sqrt(n)-th place and made again in between.
    """
    n, m = len(left), len(right)
    full, places = (1 << m) - 1, {}
    for j, name in enumerate(right):
        places.setdefault(name, []).append(m - 1 - j)
    marks: dict = {}

    def mark(name) -> int:
        """Bits of a name's places on the right; only those of frequent names are remembered."""
        if name in marks or name not in places:
            return marks.get(name, 0)
        bits = bytearray((m + 7) // 8)
        for at in places[name]:
            bits[at >> 3] |= 1 << (at & 7)
        found = int.from_bytes(bits, "little")
        if len(places[name]) ** 2 >= m:
            marks[name] = found
        return found

    def above(row: int, i: int) -> int:
        hit = row & mark(left[i])
        return ((row + hit) | (row - hit)) & full

    step = max(1, round(n ** 0.5))
    row, kept = full, {n: full}
    for i in range(n - 1, -1, -1):
        row = above(row, i)
        if i % step == 0:
            kept[i] = row
    held: dict[int, int] = {}

    def length(i: int, j: int) -> int:
        if i not in held:
            # The rows from this place to the next kept one; j only rises, so those before it are done with.
            last = min(n, (i // step + 1) * step)
            row = kept[last]
            block = {last: row}
            for k in range(last - 1, i - 1, -1):
                row = block[k] = above(row, k)
            for done in [k for k in held if k < i - 1]:
                del held[done]
            held.update(block)
        width = m - j
        return width - (held[i] & ((1 << width) - 1)).bit_count()

    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and left[i] == right[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == m or i < n and length(i + 1, j) >= length(i, j + 1):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def _pairs(left: list, right: list) -> list[tuple[int | None, int | None]]:
    """Alignment of two sibling lists by element name, in order, as many as possible."""
    names_l, names_r = [k[0] for k in left], [k[0] for k in right]
    start = 0
    while start < min(len(left), len(right)) and names_l[start] == names_r[start]:
        start += 1
    end = 0
    while end < min(len(left), len(right)) - start and names_l[-1 - end] == names_r[-1 - end]:
        end += 1
    out: list = [(i, i) for i in range(start)]
    n, m = len(left) - end - start, len(right) - end - start
    if n and m:
        out += [(i if i is None else start + i, j if j is None else start + j)
                for i, j in _longest_common(names_l[start:start + n], names_r[start:start + m])]
    else:
        out += [(start + i, None) for i in range(n)] + [(None, start + j) for j in range(m)]
    return out + [(len(left) - k, len(right) - k) for k in range(end, 0, -1)]


def align(left: list, right: list) -> list:
    """The union-free expression of two expressions of the same element."""
    kids: list = []
    for i, j in _pairs(left[1], right[1]):
        if i is None or j is None:
            one = left[1][i] if j is None else right[1][j]
            kids.append([one[0], one[1], 1, one[3]])
        else:
            kids.append(align(left[1][i], right[1][j]))
    # An optional element beside one of its name is another round of the same repeated group.
    out: list = []
    for kid in kids:
        if out and out[-1][0] == kid[0] and (kid[2] or kid[3] or out[-1][2] or out[-1][3]):
            both = align(out[-1], kid)
            out[-1] = [both[0], both[1], int(out[-1][2] and kid[2]), 1]
        else:
            out.append(kid)
    return [left[0], out, int(left[2] or right[2]), int(left[3] or right[3])]


def slots(expression: list, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Element names around every text slot of an expression."""
    if expression[0] == "#":
        return [path]
    inside = path if expression[0] == "()" else (*path, expression[0])
    return [slot for kid in expression[1] for slot in slots(kid, inside)]


def slots_of(expression: list, stream: list) -> list[int]:
    """The slot of ``expression`` that every leaf of ``stream`` falls into; -1 where none fits."""
    if expression[0] == "#":
        return [0]
    starts, at = [], 0
    for kid in expression[1]:
        starts.append(at)
        at += len(slots(kid))
    out: list[int] = []
    for i, one in _fitted(expression[1], stream[1]):
        if i is None:
            out += [-1] * len(slots(one))
        else:
            out += [starts[i] + slot if slot >= 0 else -1 for slot in slots_of(expression[1][i], one)]
    return out


def _fitted(kids: list, stream: list):
    """(place in the expression or None, kid of the stream); repeated places take several in a row."""
    at = 0
    for one in stream:
        found = next((i for i in range(at, len(kids)) if kids[i][0] == one[0]), None)
        if found is None:
            yield next((i for i in range(at) if kids[i][0] == one[0]), None), one
        else:
            yield found, one
            at = found if kids[found][3] else found + 1


def text_form(expression: list) -> str:
    """The expression as one would write it: (...)? for optional, (...)+ for repeated groups, # for text."""
    name, kids, optional, repeated = expression
    inner = "".join(text_form(kid) for kid in kids)
    whole = "#" if name == "#" else inner if name == "()" else f"<{name}>{inner}</{name.split(' ', 1)[0]}>"
    return f"({whole})" + ("*" if optional and repeated else "+" if repeated else "?") if optional or repeated else whole


def _is_content(name: str) -> bool:
    tag, _, names = name.partition(" ")
    return tag in ("article", "main") or bool(names and CONTENT_NAMES.search(names))


def _is_free(path: tuple[str, ...], content: int) -> bool:
    """Whether nothing in a slot's path stands around an article.

    Element names count anywhere, class names only from the outermost content element on: what holds an article
    may be named after the sidebar beside it.  A headline may stand in the article's own header.
    """
    headline = path[-1].split(" ", 1)[0] in ("h1", "h2") if path else False
    for at, name in enumerate(path):
        tag, _, names = name.partition(" ")
        if tag in AROUND and not (headline and tag == "header" and 0 <= content < at):
            return False
        if names and tag not in ("html", "body") and at >= content:
            marks = ASIDE_NAMES if at == content and tag in ("article", "main") else AROUND_NAMES
            if marks.search(names) and not (headline and tag == "header" and 0 <= content < at):
                return False
    return True


def judged(expression: list, facts: dict[int, tuple[int, int, int, bool]], own: dict[int, tuple[int, int]]) -> list[bool]:
    """Whether each slot holds main text on the pages of one stream.

    ``facts``: per slot of the host its pages, characters, linked characters and whether its text never changes;
    ``own``: per slot of the stream its characters and linked characters.  Slots inside what stands around an
    article are dropped.  If the stream marks articles, the slots in them are kept; else those of the innermost
    container with over half of the stream's unlinked text, without slots of links or of unchanging text.
    """
    paths = slots(expression)
    content = [next((i for i, name in enumerate(path) if _is_content(name)), -1) for path in paths]
    free = [_is_free(path, at) for path, at in zip(paths, content)]
    inner = [ok and at >= 0 for ok, at in zip(free, content)]
    if any(ok and slot in own for slot, ok in enumerate(inner)):
        return inner
    # Copies of one page alone do not show what belongs to the template.
    varied = any(ok and slot in facts and not facts[slot][3] for slot, ok in enumerate(free))
    good, weight, total = [], {}, 0
    for slot, ok in enumerate(free):
        pages, length, linked, constant = facts.get(slot, (0, 0, 0, False))
        good.append(ok and linked * 2 <= length and not (constant and varied and pages >= SAME_PAGES))
        if good[-1] and slot in own:
            length, linked = own[slot]
            total += length - linked
            for depth in range(len(paths[slot]) + 1):
                if depth and paths[slot][depth - 1].split(" ", 1)[0] in TEXT_ELEMENTS:
                    break
                weight[paths[slot][:depth]] = weight.get(paths[slot][:depth], 0) + length - linked
    inside = max((p for p, w in weight.items() if w * 2 > total), key=len, default=())
    return [ok and paths[slot][:len(inside)] == inside for slot, ok in enumerate(good)]


def _read(batches):
    for batch in batches:
        rows = []
        for page_id, url, host, page in zip(batch["page_id"], batch["url"], batch["host"], batch["html"]):
            root = parse(page or "")
            fold(root)
            stream = json.dumps(shape(root), ensure_ascii=False, separators=(",", ":"))
            found = list(leaves_of(root))
            rows.append((page_id, url, host, stream, xxhash.xxh64_intdigest(stream.encode()) - (1 << 63), [f[0] for f in found],
                         [f[1] for f in found], [f[2] for f in found]))
        yield pd.DataFrame(rows, columns=["page_id", "url", "host", "stream", "shape", "texts", "linked", "leaf"])


def _aligned(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["pages", "stream"], ascending=[False, True])
    expression = None
    for stream in rows["stream"]:
        stream = json.loads(stream)
        expression = stream if expression is None else align(expression, stream)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "stream": [json.dumps(expression, ensure_ascii=False, separators=(",", ":"))],
                         "pages": [int(rows["pages"].sum())]})


def infer_wrappers(streams: DataFrame) -> DataFrame:
    """(host, stream, pages): one expression per host from its distinct (host, stream, pages)."""
    level = streams.select("host", "stream", "pages")
    while True:
        chunks = level.groupBy("host").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        chunks = materialise(chunks, "chunks")
        most = chunks.agg(F.max("chunks")).first()[0] or 0
        dealt = level.join(chunks, "host").withColumn("chunk", F.pmod(F.xxhash64("stream"), F.col("chunks")))
        level = materialise(dealt.select("host", "chunk", "stream", "pages").groupBy("host", "chunk").applyInPandas(
            _aligned, "host string, stream string, pages long"), "expressions")
        if most <= 1:
            return level


def _slotted(batches):
    """Slots of the leaves of every distinct stream."""
    for batch in batches:
        rows = []
        for host, key, stream, wrapper in zip(batch["host"], batch["shape"], batch["stream"], batch["wrapper"]):
            for leaf, slot in enumerate(slots_of(json.loads(wrapper), json.loads(stream))):
                rows.append((host, key, leaf, slot))
        yield pd.DataFrame(rows, columns=["host", "shape", "leaf", "slot"])


def _verdicts(batches):
    for batch in batches:
        rows = []
        for host, key, wrapper, facts, leaves in zip(batch["host"], batch["shape"], batch["wrapper"], batch["facts"], batch["leaves"]):
            known = {f["slot"]: (f["pages"], f["length"], f["linked"], f["constant"]) for f in facts}
            own: dict[int, tuple[int, int]] = {}
            for f in leaves:
                length, linked = own.get(f["slot"], (0, 0))
                own[f["slot"]] = length + f["length"], linked + f["linked"]
            kept = judged(json.loads(wrapper), known, own)
            rows.append((host, key, sorted(f["leaf"] for f in leaves if kept[f["slot"]])))
        yield pd.DataFrame(rows, columns=["host", "shape", "kept_leaves"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``.

    A null or empty page, and one without main text, gives an empty text; a null URL belongs to the host without
    a name; repeated rows keep a row each; other columns are not read; an empty table gives no rows.  Very long
    pages are read whole; elements nested below DEPTH belong to the one around them.
    """
    ship_package(pages.sparkSession)
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                          F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.col(html_col).alias("html"))
    read = materialise(source.mapInPandas(_read, f"page_id {dict(source.dtypes)['page_id']}, url string, host string, stream string, "
                                                 "shape long, texts array<string>, linked array<int>, leaf array<int>"), "pages")
    streams = materialise(read.groupBy("host", "shape").agg(F.min("stream").alias("stream"), F.count("*").alias("pages")), "streams")
    wrappers = infer_wrappers(streams).select("host", F.col("stream").alias("wrapper"))
    mapped = materialise(streams.select("host", "shape", "stream").join(small_or_shuffled(wrappers, "wrappers"), "host")
                         .select("host", "shape", "stream", "wrapper").mapInPandas(_slotted, "host string, shape long, leaf int, slot int"), "slots")
    # Copies count once: each distinct page of a host belongs to one of its streams, all of whose slots it has.
    distinct = (read.select("host", "shape", F.xxhash64("texts").alias("whole")).groupBy("host", "whole").agg(F.min("shape").alias("shape"))
                .groupBy("host", "shape").agg(F.count("*").alias("distinct")))
    each = read.select("host", "shape", F.explode(F.arrays_zip("texts", "linked", "leaf")).alias("t"))
    facts = each.groupBy("host", "shape", F.col("t.leaf").alias("leaf")).agg(
        F.sum(F.length("t.texts")).alias("length"), F.sum("t.linked").alias("linked"),
        F.min(F.xxhash64("t.texts")).alias("low"), F.max(F.xxhash64("t.texts")).alias("high"))
    placed = materialise(facts.join(mapped, ["host", "shape", "leaf"]).where("slot >= 0"), "placed")
    shared = (placed.select("host", "slot", "shape").distinct().join(distinct, ["host", "shape"])
              .groupBy("host", "slot").agg(F.sum("distinct").alias("pages")))
    facts = placed.groupBy("host", "slot").agg(
        F.sum("length").alias("length"), F.sum("linked").alias("linked"),
        (F.min("low") == F.max("high")).alias("constant"))
    # A host has as many slots as its expression, however many pages.
    facts = facts.join(shared, ["host", "slot"], "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    by_host = facts.groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "length", "linked", "constant")).alias("facts"))
    by_stream = placed.groupBy("host", "shape").agg(F.collect_list(F.struct("leaf", "slot", "length", "linked")).alias("leaves"))
    # Every stream is judged by itself, so pages of a second layout keep their text.
    kept = (by_stream.join(small_or_shuffled(wrappers.join(by_host, "host").select("host", "wrapper", "facts"), "facts"), "host")
            .select("host", "shape", "wrapper", "facts", "leaves").mapInPandas(_verdicts, "host string, shape long, kept_leaves array<int>"))
    met = read.select("page_id", "url", "host", "shape", "texts", "leaf").join(small_or_shuffled(kept, "kept"), ["host", "shape"], "left")
    chosen = F.filter("texts", lambda text, at: F.array_contains("kept_leaves", F.element_at("leaf", at + 1)))
    text = F.coalesce(F.array_join(chosen, "\n"), F.lit(""))
    return met.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
