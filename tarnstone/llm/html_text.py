"""Operator 10, HTML extraction: union-free wrappers inferred from same-host token streams, and the main text by wrapper."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.llm.common import read_table, stage, unstage

#: Streams that one task aligns; a host of more is dealt to several tasks, whose wrappers are aligned again.
STREAMS = 200
#: Different pages that must show one text in one slot before it counts as the host's own.
TEMPLATE_PAGES = 5
#: Share of the varying text that a part of the main element must hold to be it instead.
MAIN_SHARE = 0.6
#: Longest sequence of elements that is recognised when it repeats.
SQUARE = 3
#: Elements in one another that a wrapper tells apart; what stands deeper counts as part of these. Texts are read at any depth.
DEEP = 100

# Elements by role, as HTML has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template select option button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
LISTED = frozenset("p li tr td th dt dd h1 h2 h3 h4 h5 h6 blockquote pre".split())
OUTER = frozenset("html body".split())
#: Elements that an element of the given names ends where it begins; a paragraph is ended by every block.
ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
CONTENT = ("article", "main")
#: What the main text is to be without: menus, headers, footers, sidebars, notices, adverts, forms and comments, by element
#: and by class, id or role. A class counts if it has such a word and no others than those of LAYOUT.
DROPPED = frozenset("nav header footer aside form head dialog menu".split()) | RAW
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus "
    "footer gdpr header login masthead menu modal navbar nav navigation newsletter notice notices notification overlay pager pagination popup promo "
    "promotion related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
LAYOUT = frozenset("area bar block bottom box button buttons container content footer form inner items left line links list main outer page posts right section site slot thread top unit wrap wrapper".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")


def events(page: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """(kind, name or text, marks): open, close, text. Raw elements give an open and a close event and no text.

    Marks are the classes and roles, the id behind a '#', and 'hidden'.
    """
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], ()
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ()
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            yield "close", name, ()
            continue
        if at == n and not m.group().endswith(">"):
            return  # the page ends inside a tag
        marks: list[str] = []
        for key, x, y, z in _ATTRIBUTE.findall(m[3]) if m[3] else ():
            key, value = key.lower(), (x or y or z).lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                marks.append("hidden")
            elif key == "id":
                marks.extend(f"#{w}" for w in value.split())
            elif key in ("class", "role"):
                marks.extend(value.split())
        yield "open", name, tuple(marks)
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            yield "close", name, ()
        elif name in VOID or m[3].endswith("/"):
            yield "close", name, ()


def is_dropped(name: str, marks: tuple[str, ...], inside: bool = False) -> bool:
    """Whether an element is no main text. inside: it stands in the main element, where ids are slugs of headings."""
    if name in OUTER:
        return False
    if "hidden" in marks:
        return True
    if name in CONTENT:
        return False
    if name in DROPPED and not (inside and name == "header"):
        return True
    for mark in marks:
        if not (inside and mark[0] == "#"):
            words = set(_WORD.findall(mark))
            if words & MARKS and words <= MARKS | LAYOUT:
                return True
    return False


def _key(name: str, marks: tuple[str, ...]) -> str:
    """What tells an element from its neighbours in a wrapper: the name and the first class or id without a number."""
    for mark in marks:
        if mark != "hidden" and not any(c.isdigit() for c in mark):
            return f"{name}.{mark}"
    return name


def _ends(name: str, new: str) -> bool:
    return name == "p" or new in ENDED.get(name, ())


def _slot(path: list[str], text: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join([*path[:DEEP], text]).encode("utf-8", "replace"), digest_size=7).digest(), "big")


# A stream and a wrapper are lists of items. An element is [key, sign, dropped, items], with sign '' (once), '?' (optional),
# '+' (repeated) or '*' (both); a repeated sequence is an element with a key in brackets. A text slot is
# ['#', pages, characters, those in links, least and greatest hash of its texts].


def merge(a: list, b: list) -> list:
    """One item for two of one key."""
    if a[0] == "#":
        return ["#", a[1] + b[1], a[2] + b[2], a[3] + b[3], min(a[4], b[4]), max(a[5], b[5])]
    return [a[0], _sign(a[1] + b[1]), a[2], align(a[3], b[3])]


def _sign(signs: str) -> str:
    many, maybe = "+" in signs or "*" in signs, "?" in signs or "*" in signs
    return ("*" if maybe else "+") if many else ("?" if maybe else "")


def align(a: list, b: list) -> list:
    """One wrapper for both lists: items of one key are merged, and where the lists do not match, items become optional."""
    x, y = [i[0] for i in a], [i[0] for i in b]
    if x == y:
        return [merge(i, j) for i, j in zip(a, b, strict=True)]
    out: list = []
    maybe = lambda items: [i if i[0] == "#" else [i[0], _sign(i[1] + "?"), i[2], i[3]] for i in items]
    for tag, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if tag == "equal":
            out += [merge(p, q) for p, q in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += maybe(a[i:j]) + maybe(b[k:m])
    return out


def fold(items: list) -> list:
    """items with squares resolved: a sequence of elements that follows one of the same keys is merged with it and repeated."""
    out: list = []
    for item in items:
        out.append(item)
        again = True
        while again:
            again = False
            for n in range(1, SQUARE + 1):
                last = out[-n:]
                keys = [i[0] for i in last]
                if len(out) <= n or keys == ["#"]:
                    continue
                name = f"({' '.join(keys)})"
                if n == 1 and out[-2][0][0] == "(" and out[-2][3][-1][0] == keys[0]:
                    tail = merge(out[-2][3].pop(), out.pop())  # the group's last element goes on
                    out[-1][3].append([tail[0], _sign(tail[1] + "+"), tail[2], tail[3]])
                    again = True
                    break
                if n > 1 and out[-n - 1][0] == name:
                    group = out[-n - 1]
                    out[-n - 1 :] = [[name, group[1], group[2], [merge(p, q) for p, q in zip(group[3], last, strict=True)]]]
                elif [i[0] for i in out[-2 * n : -n]] == keys:
                    both = [merge(p, q) for p, q in zip(out[-2 * n : -n], last, strict=True)]
                    out[-2 * n :] = [[keys[0], _sign(both[0][1] + "+"), both[0][2], both[0][3]]] if n == 1 else [[name, "+", False, both]]
                else:
                    continue
                again = True
                break
    return out


def stream(page: str) -> list:
    """The page as a wrapper of its own: block elements with text slots, and repeated groups where squares show them."""
    root: list = []
    stack: list[tuple[str, str, bool, list]] = [("", "", False, root)]
    path: list[str] = []
    text: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        block = _BLANK.sub(" ", html.unescape("".join(text))).strip()
        if block:
            h = _slot(path, block)
            stack[-1][3].append(["#", 1, len(block), min(linked, len(block)), h, h])
        text.clear()
        linked = 0

    def close() -> None:
        name, key, dropped, items = stack.pop()
        if name not in OUTER:
            path.pop()
        if name in OUTER or len(stack) > DEEP:
            stack[-1][3].extend(items)
        else:
            stack[-1][3].append([key, "", dropped, fold(items)])

    for kind, value, marks in events(page):
        if kind == "text":
            text.append(value)
            linked += len(value.strip()) if in_link else 0
        elif value == "a":
            in_link = max(0, in_link + (1 if kind == "open" else -1))
        elif value in INLINE:
            continue
        else:
            flush()
            if value in VOID:
                continue
            if kind == "open":
                while _ends(stack[-1][0], value):
                    close()
                stack.append((value, _key(value, marks), is_dropped(value, marks), []))
                if value not in OUTER:
                    path.append(stack[-1][1])
            elif any(s[0] == value for s in stack[1:]):
                while stack[-1][0] != value:
                    close()
                close()
    flush()
    while len(stack) > 1:
        close()
    return fold(root)


def shape(items: list) -> tuple[list, list]:
    """(items without what their slots hold, the slots in order)."""
    slots: list = []

    def bare(xs: list) -> list:
        out = []
        for x in xs:
            if x[0] == "#":
                slots.append(x)
                out.append("#")
            else:
                out.append([x[0], x[1], x[2], bare(x[3])])
        return out

    return bare(items), slots


def filled(items: list, slots: Iterator) -> list:
    """The reverse of shape."""
    return [["#", *next(slots)] if x == "#" else [x[0], x[1], x[2], filled(x[3], slots)] for x in items]


def rule(wrapper: list) -> tuple[list[str], list[int]]:
    """(path of keys to the main element, empty for the whole page; hashes of the host's own texts), as the wrapper tells.

    A slot outside repeated groups that shows one text on TEMPLATE_PAGES different pages, while others vary, is the host's
    own. The main element is found from the page inwards, as the part that alone holds MAIN_SHARE of the varying text, up to
    an article or main. Where the varying text is spread over parts, the tag decides: the article or main of the most text,
    if it holds what MAIN_SHARE leaves.
    """
    own: list[int] = []

    def constant(x: list, repeated: bool) -> bool:
        return not repeated and x[1] >= TEMPLATE_PAGES and x[4] == x[5]

    def mass(items: list, repeated: bool) -> float:
        total = 0.0
        for x in items:
            if x[0] == "#":
                total += 0 if constant(x, repeated) else max(0, x[2] - x[3])
            elif not x[2]:
                total += mass(x[3], repeated or x[1] in ("+", "*"))
        return total

    def owned(items: list) -> None:
        for x in items:
            if x[0] == "#":
                if constant(x, False):
                    own.append(x[4])
            elif x[1] not in ("+", "*"):
                owned(x[3])

    def named(items: list, path: list[str]) -> Iterator[tuple[float, list[str], list]]:
        for x in items:
            if x[0] != "#" and not x[2] and x[1] not in ("+", "*"):
                if x[0].split(".")[0] in CONTENT:
                    yield mass(x[3], False), [*path, x[0]], x[3]
                yield from named(x[3], [*path, x[0]])

    tag = lambda key: key.split(".")[0]
    path: list[str] = []
    items = wrapper
    while not (path and tag(path[-1]) in CONTENT):
        parts = [(mass(x[3], False), tag(x[0]) in CONTENT, x) for x in items if x[0] != "#" and not x[2] and x[1] not in ("+", "*") and tag(x[0]) not in LISTED]
        most, _, x = max(parts, key=lambda f: (f[0], f[1], f[2][0]), default=(0.0, False, None))
        if x is None or most <= 0 or most < MAIN_SHARE * mass(items, False):
            break
        path, items = [*path, x[0]], x[3]
    # Where no part holds enough, and where an article or main holds as much as the part it stands in, the tag decides.
    inner = max(named(items, path), key=lambda f: (f[0], f[1]), default=None)
    if inner is not None:
        least = mass(items, False) if path and tag(path[-1]) in CONTENT else (1 - MAIN_SHARE) * mass(items, False)
        if inner[0] >= least:
            path, items = inner[1], inner[2]
    if mass(items, False) > 0:  # else all its pages are alike, and nothing tells the host's texts from theirs
        owned(items)
    return path, own


def main_text(page: str, path: list[str] | tuple = (), own: frozenset[int] = frozenset()) -> str:
    """Blocks of the page in its main element, without what is dropped and the host's own texts, joined by one space."""
    path = list(path)
    found: list[str] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = [("", False, not path, False)]  # name, dropped, in the main element, listed in here
    here: list[str] = []
    seen = not path

    def flush() -> None:
        block = _BLANK.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        if block and not (own and _slot(here, block) in own):
            found.append(block)

    def close() -> None:
        if stack.pop()[3]:
            here.pop()

    for kind, value, marks in events(page):
        if kind == "text":
            if not stack[-1][1] and stack[-1][2]:
                text.append(value)
            continue
        if value in INLINE:
            continue
        flush()
        if value in VOID:
            continue
        if kind == "open":
            while _ends(stack[-1][0], value):
                close()
            inside = bool(path) and stack[-1][2]
            if value not in OUTER:
                here.append(_key(value, marks))
            main = stack[-1][2] or (value not in OUTER and here == path)
            seen |= main
            stack.append((value, stack[-1][1] or is_dropped(value, marks, inside), main, value not in OUTER))
        elif any(s[0] == value for s in stack[1:]):
            while stack[-1][0] != value:
                close()
            close()
    flush()
    if not seen:  # the page has no such element: by its own wrapper
        alone = rule(stream(page))[0]
        return main_text(page, alone if alone != path else ())
    return " ".join(found)


def wrappers(pages: DataFrame, streams: int = STREAMS) -> DataFrame:
    """Staged (host, rule): the rule of one wrapper a host, as JSON.

    Pages of one shape are added up before anything is aligned, pages that are alike count once, and the shapes of a host are
    aligned in a tree of tasks of so many streams each.
    """

    @F.pandas_udf("shape string, v array<long>, l array<long>, h array<long>")
    def as_stream(pages_: pd.Series) -> pd.DataFrame:
        rows = [shape(stream(p)) for p in pages_]
        return pd.DataFrame({"shape": [json.dumps(x) for x, _ in rows], "v": [[s[2] for s in y] for _, y in rows], "l": [[s[3] for s in y] for _, y in rows], "h": [[s[4] for s in y] for _, y in rows]})

    def as_wrapper(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [json.dumps(filled(json.loads(x), iter([[s["n"], s["v"], s["l"], s["lo"], s["hi"]] for s in y]))) for x, y in zip(pdf["shape"], pdf["slots"], strict=True)]
        return pd.DataFrame({"host": pdf["host"], "wrapper": out})

    def aligned(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list | None = None
        for w in sorted(pdf["wrapper"], key=lambda w: (-len(w), w)):
            out = json.loads(w) if out is None else align(out, json.loads(w))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(out)]})

    @F.pandas_udf("string")
    def ruled(ws: pd.Series) -> pd.Series:
        return ws.map(lambda w: json.dumps(rule(json.loads(w))))

    each = pages.select("host", as_stream("html").alias("s")).select("host", "s.*")
    each = stage(each.withColumn("alike", F.xxhash64("h")).dropDuplicates(["host", "shape", "alike"]).drop("alike"), "html-streams")
    slots = each.select("host", "shape", F.posexplode(F.arrays_zip("v", "l", "h")).alias("pos", "x"))
    slots = slots.groupBy("host", "shape", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("x.v").alias("v"), F.sum("x.l").alias("l"), F.min("x.h").alias("lo"), F.max("x.h").alias("hi"))
    slots = slots.groupBy("host", "shape").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "v", "l", "lo", "hi"))).alias("slots"))
    level = stage(slots.mapInPandas(lambda it: (as_wrapper(p) for p in it), "host string, wrapper string"), "html-level")
    unstage(each)
    while True:
        sizes = level.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        dealt = level.join(sizes, "host").withColumn("deal", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / F.lit(streams)).cast("long")))
        new = stage(dealt.groupBy("host", "deal").applyInPandas(aligned, "host string, wrapper string"), "html-level")
        unstage(level)
        level = new
    out = stage(level.select("host", ruled("wrapper").alias("rule")), "html-rules")
    unstage(level)
    return out


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row a page: page_id, url, text, n_chars (code points).

    The pages of a host are turned into streams of block elements and text slots and aligned into one wrapper. Where the
    wrapper has the main text, each page's is read, without what DROPPED and MARKS name and without texts that the wrapper
    shows to be the host's own. A null or empty page has an empty text; null urls form one host; repeated rows are each
    extracted; broken markup is read as far as it goes; very long pages are read whole; an empty table gives an empty one;
    other columns are not looked at.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    @F.pandas_udf("string")
    def text_of(pages_: pd.Series, rules: pd.Series) -> pd.Series:
        known: dict[str, tuple] = {}
        out = []
        for p, r in zip(pages_, rules, strict=True):
            if r not in known:
                path, own = json.loads(r)
                known = {r: (path, frozenset(own))}
            out.append(main_text(p, *known[r]))
        return pd.Series(out, dtype=object)

    joined = rows.join(wrappers(rows.select("host", "html")), "host", "left")
    out = joined.select("page_id", "url", text_of("html", F.coalesce("rule", F.lit("[[], []]"))).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
