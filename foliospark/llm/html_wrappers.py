"""HTML extraction (3): union-free regular expressions of each host's pages as wrappers."""

from __future__ import annotations

import html as _html
import json
import re
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import release, stored, table
from foliospark.llm.url_rules import host_of

#: Wrappers of all hosts together are sent to the tasks up to so many bytes; beyond, they are joined.
BROADCAST_BYTES = 16 << 20
#: So many different shapes of a host are aligned in a task; what comes out is aligned in turn.
FAN = 64
#: A string that so many of the pages that show its place have there is template, from so many
#: different pages on.
CONSTANT = 0.9
LEAST_PAGES = 3
#: Stands for all places of a page: a string that moves between slots is template by it.
ANY = -2
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|([^<]+|<)", re.S)
_NAME = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "xmp")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose open p, li, ... a new one closes.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
_SCOPE = frozenset("article aside body div footer form header html main nav section table td th ul ol dl".split())
_OUT_TAGS = frozenset("nav footer aside form button select dialog menu head label input".split()) | set(_RAW)
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar side aside related recommended widget comment comments reply replies disqus respond notice notices cookie cookies consent gdpr alert popup modal newsletter subscribe subscription signup login share sharing social toolbar pagination pager skip search copyright legal disclaimer".split()
)
_LAYOUT = frozenset("has with no layout wrapper container page site".split())
_MAIN = ("article", "main")
_OUT_MAIN = frozenset("comment comments reply ad advert promo related".split())


@lru_cache(4096)
def words_of(attributes: str) -> list[str]:
    """Words of an element's class, id and role."""
    return [w for m in _NAME.finditer(attributes) for w in re.split(r"[^a-z]+", next(x for x in m.groups() if x is not None).lower()) if w]


def tokens(page: str):
    """(kind, name, text): 'open' and 'close' with an element's name and '.'-joined class words,
    and 'text' with what stands there. Comments, declarations and what raw elements hold go."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[5] is not None:
            yield "text", "", m[5]
        elif m[2] is not None:
            if m[4] != ">":  # the page ends within a tag
                return
            name = m[2].lower()
            if m[1]:
                yield "close", name, ""
                continue
            yield "open", ".".join([name, *words_of(m[3])]) if m[3] else name, ""
            if name in _VOID or m[3].endswith("/") and name in _RAW:
                continue
            if name in _RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
                yield "close", name, ""


class Around(NamedTuple):
    """What the open elements around a block say of it."""

    out: bool = False  # a menu, header, footer, sidebar, notice, advert, form or comments
    outer: bool = False  # the same, by an element that also names the page's layout
    main: bool = False  # an article or main part

    def entered(self, tag: str, words: list[str]) -> Around:
        """The labels within one more element. Around an article, words of an element that only
        names the page's layout (`layout has-sidebar`) don't count."""
        out, outer, main = self.out, self.outer, self.main or tag in _MAIN
        if tag in _OUT_TAGS or tag == "header" and not main:
            out = True
        elif tag in _MAIN:
            outer = False
            out |= not _OUT_MAIN.isdisjoint(words)
        elif words and tag not in ("body", "html") and _OUT_WORDS & set(words) - ({"header"} if main else set()):
            if _LAYOUT.isdisjoint(words):
                out = True
            else:
                outer = True
        return self if (out, outer, main) == self else Around(out, outer, main)

    @property
    def boilerplate(self) -> bool:
        return self.out or self.outer


@lru_cache(4096)
def _entered(around: Around, name: str) -> Around:
    tag, *words = name.split(".")
    return around.entered(tag, words)


class Reader:
    """A page's blocks in order, with the labels of the elements that are open around each."""

    def __init__(self, page: str):
        self.shape: list[str] = []
        self.blocks: list[tuple[Around, str, int]] = []  # labels, text, characters of it in links
        stack: list[tuple[str, Around]] = []
        open_: dict[str, int] = {}  # of each name
        held: list[str] = []
        linked = 0
        around = top = Around()

        def flush():
            nonlocal held, linked
            if not held:
                return
            text = "".join(held)
            text = " ".join((_html.unescape(text) if "&" in text else text).split())
            if text:
                self.blocks.append((around, text, linked))
                self.shape.append("#")
            held, linked = [], 0

        def shut(tag: str, scope=frozenset()):
            """Closes the innermost open element of this name and what is in it."""
            if not open_.get(tag):
                return
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    for t, _ in stack[k:]:
                        open_[t] -= 1
                    del stack[k:]
                    return
                if stack[k][0] in scope:
                    return

        for kind, name, text in tokens(page):
            tag = name.partition(".")[0]
            if kind == "text":
                if not held:
                    around = stack[-1][1] if stack else top
                held.append(text)
                if open_.get("a"):
                    linked += len(text.strip())
                continue
            if tag in _BLOCK or tag in _OUT_TAGS:
                flush()
            elif tag == "br":
                held.append(" ")
                continue
            if kind == "open":
                for closed in _CLOSES.get(tag, ("p",) if tag in _BLOCK else ()):
                    shut(closed, _SCOPE - {closed})
                if tag not in _VOID:
                    stack.append((tag, _entered(stack[-1][1] if stack else top, name)))
                    open_[tag] = open_.get(tag, 0) + 1
                self.shape.append(f"<{name}>")
            else:
                shut(tag)
                self.shape.append(f"</{tag}>")
        flush()


# A wrapper is a list of nodes: a token, ["+", wrapper] for a group that repeats, ["?", wrapper]
# for one that may be missing; "#" is a text slot. It is a regular expression without unions.


#: Nodes that characters of the private-use planes can stand for.
LETTERS = 120_000


def fold(shape: list) -> list:
    """Repeats of up to eight nodes as one repeated group, innermost first. A shape is a text of a
    character a node, which patterns fold; one of more nodes than there are such characters is
    a list of numbers, folded alike in Python."""
    number: dict[str, int] = {}
    nodes: list = []

    def code(node) -> int:
        key = node if isinstance(node, str) else json.dumps(node)
        if key not in number:
            number[key] = len(nodes)
            nodes.append(node)
        return number[key]

    now = [code(n) for n in shape]
    if len(nodes) + len(shape) <= LETTERS:
        text = "".join(map(_letter, now))
        for width in range(1, 9):
            text = _REPEATS[width].sub(lambda m: _letter(code(["+", [nodes[_place(c)] for c in m[1]]])), text)
            # a group and one more of what it repeats are one
            text = _TWICE.sub(r"\1", text)
        return [nodes[_place(c)] for c in text]
    for width in range(1, 9):
        same = [0] * (len(now) + 1)  # how far each place goes on as it does `width` later
        for i in range(len(now) - width - 1, -1, -1):
            same[i] = same[i + 1] + 1 if now[i] == now[i + width] else 0
        out: list[int] = []
        i = 0
        while i < len(now):
            times = same[i] // width
            got = code(["+", [nodes[c] for c in now[i : i + width]]]) if times else now[i]
            if not out or out[-1] != got:
                out.append(got)
            i += width * (times + 1) if times else 1
        now = out
    return [nodes[c] for c in now]


_REPEATS = {width: re.compile(rf"(.{{{width}}})\1+") for width in range(1, 9)}
_TWICE = re.compile(r"(.)\1+")


def _letter(k: int) -> str:
    return chr(0xE000 + k) if k < 0x1900 else chr(0xF0000 + k - 0x1900)


def _place(c: str) -> int:
    return ord(c) - 0xE000 if ord(c) < 0xF0000 else ord(c) - 0xF0000 + 0x1900


def _label(node) -> str:
    return node if isinstance(node, str) else node[0] + _label(node[1][0]) if node[1] else node[0]


def _gather(w: list, bodies: list[list]) -> list:
    """w with each run of a group's body, standing once, as that group."""
    out: list = []
    i = 0
    while i < len(w):
        body = next((b for b in bodies if w[i : i + len(b)] == b), None)
        if body is None:
            out.append(w[i])
            i += 1
        else:
            out.append(["+", body])
            i += len(body)
    return out


def align(a: list, b: list) -> list:
    """The least general wrapper of this alignment that matches what either matches."""
    if a == b:
        return a
    a, b = _gather(a, [n[1] for n in b if n[0] == "+" and not isinstance(n, str)]), _gather(b, [n[1] for n in a if n[0] == "+" and not isinstance(n, str)])
    plain = lambda w: [(m, g if m is not n else None) for g, n in enumerate(w) for m in (n[1] if not isinstance(n, str) and n[0] == "?" else [n])]
    x, y = plain(a), plain(b)  # nodes, and the optional group that each comes from
    out: list = []
    last = None

    def add(node, *tag):
        """Nodes of one tag stand in one optional group; without a tag they are in all pages."""
        nonlocal last
        if tag == (None, None):
            out.append(node)
        elif tag == last:
            out[-1][1].append(node)
        else:
            out.append(["?", [node]])
        last = tag

    for op, i, j, k, m in SequenceMatcher(None, [_label(n) for n, _ in x], [_label(n) for n, _ in y], autojunk=False).get_opcodes():
        if op == "equal":
            for (n, g), (o, h) in zip(x[i:j], y[k:m]):
                add(n if n == o or isinstance(n, str) else [n[0], align(n[1], o[1])], g, h)
        else:
            for n, g in x[i:j]:
                add(n, g, f"a{i}")
            for n, h in y[k:m]:
                add(n, f"b{k}", h)
        last = None
    return out


class Matcher:
    """A wrapper as an automaton over the shapes of pages: at which text slot of the wrapper each
    text of a page stands. A place is the number of the slot's state."""

    def __init__(self, wrapper: list):
        self.token: list[str | None] = [None]  # None: goes on without a token
        self.next: list[tuple[int, ...]] = [()]  # of state 0, the end
        self.start = self._build(wrapper, 0)
        self.steps: dict[int, dict[str, list[int]]] = {}

    def _state(self, token: str | None, *after: int) -> int:
        self.token.append(token)
        self.next.append(after)
        return len(self.token) - 1

    def _build(self, wrapper: list, after: int) -> int:
        for n in reversed(wrapper):
            if isinstance(n, str):
                after = self._state(n, after)
            elif n[0] == "?":
                after = self._state(None, self._build(n[1], after), after)
            else:
                loop = self._state(None)
                body = self._build(n[1], loop)
                self.next[loop] = (body, after)
                after = body
        return after

    def _steps(self, state: int) -> dict[str, list[int]]:
        """Which states with a token follow, by token; '' for the end. Groups come before what
        stands behind them."""
        got = self.steps.get(state)
        if got is None:
            got, seen, open_ = {}, set(), [state]
            while open_:
                k = open_.pop()
                if k in seen:
                    continue
                seen.add(k)
                if k == 0:
                    got.setdefault("", []).append(0)
                elif self.token[k] is not None:
                    got.setdefault(self.token[k], []).append(k)
                else:
                    open_.extend(reversed(self.next[k]))
            self.steps[state] = got
        return got

    def places(self, shape: list[str]) -> list[int] | None:
        """The place of each text of a page's shape; None if the wrapper doesn't match it."""
        now: dict = {self.start: None}  # the state to go on from: the places so far
        for token in shape:
            then: dict = {}
            for state, held in now.items():
                for k in self._steps(state).get(token, ()):
                    then.setdefault(self.next[k][0], (k, held) if token == "#" else held)
            if not then:
                return None
            now = then
        for state, held in now.items():
            if "" in self._steps(state):
                out = []
                while held is not None:
                    out.append(held[0])
                    held = held[1]
                return out[::-1]
        return None


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _shapes(batches):
    """Rows (host, what): the folded shapes of pages, each once a batch."""
    for batch in batches:
        seen = {(host, json.dumps(fold(Reader(page).shape), separators=(",", ":"))) for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*sorted(seen))], names=["host", "what"])


def _partly(pdf: pd.DataFrame) -> pd.DataFrame:
    out = None
    for shape in sorted(pdf["what"], key=lambda s: (len(s), s)):
        out = json.loads(shape) if out is None else align(out, json.loads(shape))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "what": [json.dumps(out, separators=(",", ":"))]})


def _merged(shapes: DataFrame) -> DataFrame:
    """(host, what): one wrapper a host. Its shapes are dealt into parts of some FAN, the parts'
    wrappers again, until a host has one; a task never aligns more than a few FAN."""
    while True:
        sizes = shapes.groupBy("host").agg(F.count(F.lit(1)).alias("m"))
        most = sizes.agg(F.max("m")).first()[0] or 0
        if most <= 1:
            return shapes
        last, dealt = shapes, shapes.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("what"), F.ceil(F.col("m") / FAN)))
        shapes = stored(dealt.select("host", "part", "what").groupBy("host", "part").applyInPandas(_partly, "host string, what string").distinct(), "wrappers")
        release(shapes.sparkSession, last)


class _Wrappers:
    """Matchers of the wrappers that were used last."""

    def __init__(self):
        self.held: dict[str, Matcher] = {}

    def places(self, wrapper: str | None, reader: Reader) -> list[int]:
        """The place of each block, -1 where the page's host has no wrapper that matches it."""
        got = None
        if wrapper is not None:
            if wrapper not in self.held:
                if len(self.held) >= 256:
                    self.held.clear()
                self.held[wrapper] = Matcher(json.loads(wrapper))
            got = self.held[wrapper].places(reader.shape)
        return [-1] * len(reader.blocks) if got is None else got


def _with_wrappers(rows: DataFrame, wrappers: DataFrame, columns: list[str]):
    """rows, which have a __host, and what a task looks a host's columns up in: a broadcast
    where wrappers are small, by measure; otherwise None, and each row has them in __wrapper."""
    size = wrappers.agg(F.sum(F.length(F.to_json(F.struct("host", *columns))) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        held = {r[0]: tuple(r[1:]) for r in wrappers.select("host", *columns).collect()}
        return rows, rows.sparkSession.sparkContext.broadcast(held)
    kept = rows.columns
    return rows.join(wrappers.select(F.col("host").alias("__host"), F.struct(*columns).alias("__wrapper")), "__host", "left").select(*kept, "__wrapper"), None


def _looked_up(batch, at: int, held):
    """The wrapper of each row, with the host in column `at` and the joined wrapper as the last."""
    if held is not None:
        return [held.value.get(h) for h in batch.column(at).to_pylist()]
    return [w and tuple(w.values()) for w in batch.column(batch.num_columns - 1).to_pylist()]


def _strings(held):
    """Rows (host, core, blocks) of pages: where in the wrapper each block stands, the digest of
    its text, whether it is the page's first block of this place and of this string there, its
    characters and those in links. core: the longest block without a label, by which copies and
    near copies of a page are folded."""
    fields = [("place", pa.int32()), ("string", pa.int64()), ("shows", pa.int32()), ("has", pa.int32()), ("chars", pa.int64()), ("linked", pa.int64())]
    kind = pa.list_(pa.struct(fields))

    def run(batches):
        known = _Wrappers()
        for batch in batches:
            hosts, cores, rows = [], [], []
            for host, page, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _looked_up(batch, 0, held)):
                r = Reader(page)
                if not r.blocks:
                    continue
                seen: set = set()
                row = []
                for place, (_, text, linked) in zip(known.places(w and w[0], r), r.blocks):
                    string = _digest(text)
                    row.append({"place": place, "string": string, "shows": int(place not in seen), "has": int((place, string) not in seen), "chars": len(text), "linked": linked})
                    seen |= {place, (place, string)}
                strings = dict.fromkeys(b["string"] for b in row)
                row += [{"place": ANY, "string": x, "shows": int(i == 0), "has": 1, "chars": 0, "linked": 0} for i, x in enumerate(strings)]
                own = [text for around, text, _ in r.blocks if not around.boilerplate] or [text for _, text, _ in r.blocks]
                hosts.append(host)
                cores.append(_digest(max(own, key=lambda t: (len(t), t))))
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(cores, pa.int64()), pa.array(rows, kind)], names=["host", "core", "blocks"])

    return run


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper, template, links) from all pages: each host's union-free regular expression,
    the strings at its slots that are template, and its slots that hold mostly links.

    Pages are reduced to their folded shapes where they are read; only different shapes are
    shuffled and aligned, as a tree of parts of some FAN shapes, so a host with most of the
    pages costs no more than its kinds of page. Then each page is
    matched against its host's wrapper, which aligns the strings of different pages slot by
    slot; a string that nearly all of them have at a slot, or anywhere, is template. Pages with the same
    longest text count once. Null html has no shape; a null url belongs to the host ''.
    """
    rows = pages.select(host_of(F.col(url)).alias("__host"), F.col(html).alias("__html")).where("__html IS NOT NULL")
    wrappers = _merged(stored(rows.mapInArrow(_shapes, "host string, what string").distinct(), "shapes")).withColumnRenamed("what", "wrapper")

    rows, held = _with_wrappers(rows, wrappers, ["wrapper"])
    placed = rows.mapInArrow(_strings(held), "host string, core long, blocks array<struct<place int, string long, shows int, has int, chars long, linked long>>")
    one = placed.groupBy("host", "core").agg(F.min(F.struct(F.xxhash64("blocks").alias("h"), "blocks")).alias("page"))
    strings = one.select("host", F.explode("page.blocks").alias("b")).select("host", "b.*").groupBy("host", "place", "string").agg(*[F.sum(c).alias(c) for c in ("shows", "has", "chars", "linked")])
    strings = stored(strings, "strings")
    slots = stored(strings.groupBy("host", "place").agg(*[F.sum(c).alias(c) for c in ("shows", "chars", "linked")]), "slots")
    # only strings of LEAST_PAGES pages can be template, so few rows of a slot meet its count
    often = strings.where((F.col("place") != -1) & (F.col("has") >= LEAST_PAGES)).select("host", "place", "string", "has")
    fixed = often.join(slots.select("host", "place", "shows"), ["host", "place"]).where(F.col("has") >= CONSTANT * F.col("shows"))
    template = fixed.groupBy("host").agg(F.collect_list(F.struct("place", "string")).alias("template"))
    links = slots.where("place >= 0 AND linked * 2 > chars").groupBy("host").agg(F.collect_list("place").alias("links"))
    return wrappers.join(template, "host", "left").join(links, "host", "left")


def text_of(r: Reader, places: list[int], template: dict[int, set[int]], links: set[int]) -> str:
    """What stands at the wrapper's text slots and is no template, two line breaks between blocks.
    Slots labelled boilerplate are no article; slots in article or main are, and on pages where
    these show nothing all others that don't hold mostly links. What stands in article or main is
    template by its own slot only."""
    main, rest = [], []
    anywhere = template.get(ANY, set())
    for place, (around, text, _) in zip(places, r.blocks):
        fixed = template.get(place, set())
        if around.boilerplate or fixed and _digest(text) in fixed or anywhere and not around.main and _digest(text) in anywhere:
            continue
        if around.main:
            main.append(text)
        elif place not in links:
            rest.append(text)
    return "\n\n".join(main or rest)


def extract(pages: DataFrame, wrappers: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", html: str = "html") -> DataFrame:
    """The article's text of each page by its host's wrapper: the columns `keep`, text, n_chars.

    Null and empty html, and pages without an article, give an empty text; repeated rows give
    equal texts; pages of any length and depth are read once, from front to back. Wrappers go to all
    tasks where they are small, by measure; otherwise each page is joined with its host's.
    """
    rows = pages.select(*[F.col(c) for c in keep], host_of(F.col(url)).alias("__host"), F.col(html).alias("__html"))
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"
    rows, held = _with_wrappers(rows, wrappers, ["wrapper", "template", "links"])

    def run(batches):
        known = _Wrappers()
        for batch in batches:
            texts = []
            for page, w in zip(batch.column(len(keep) + 1).to_pylist(), _looked_up(batch, len(keep), held)):
                r = Reader(page or "")
                wrapper, strings, links = w or (None, None, None)
                template: dict[int, set[int]] = {}
                for place, string in (s.values() if isinstance(s, dict) else s for s in strings or ()):
                    template.setdefault(place, set()).add(string)
                texts.append(text_of(r, known.places(wrapper, r), template, set(links or ())))
            cols = [pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def op3_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages, by the wrappers of their hosts."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, stored(infer_wrappers(pages), "wrappers"))


QUERIES = {"op3_html_wrappers": op3_html_wrappers}
ORACLES: dict[str, str] = {}
