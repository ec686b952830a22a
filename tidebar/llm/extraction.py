"""Main text of web pages: the maximum-scoring contiguous run of words and tags."""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import col, whole

# Element names of HTML by what they are for
RAW = ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "title", "select", "button", "canvas", "audio", "video")
ASIDE = frozenset((*RAW, "head", "nav", "footer", "aside", "header", "menu", "dialog"))
FORMS = frozenset(("form", "fieldset"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
    "ol p pre section table ul".split()
)
#: Words in a class, id or role that name what is not the article.
CUES = re.compile(
    r"(?:^|[\s_-])(ads?|adverts?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|topbar|masthead|header|footer|sidebar\w*|"
    r"side|aside|comments?|commentlist|respond|replies|disqus|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|signup|login|"
    r"search|share|sharing|social|related|recommend\w*|widget\w*|copyright|skip|toolbar|pagination|pager|dialog|complementary|contentinfo|"
    r"navigation)(?=$|[\s_-])",
    re.I,
)
#: Those of them that inside an article may name a part of it, and compounds that always do.
DOUBTFUL = re.compile(r"header|banner|masthead|search|related|recommend\w*|side|skip", re.I)
OWN = re.compile(r"(?:^|\s)(?:entry|post|article|story|content)[_-]?(?:header|banner)(?=$|\s)", re.I)
MAIN = re.compile(r"(?:^|\s)(?:articleBody|article|main)(?:$|\s)")
TOKENS = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*+)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACES = re.compile(r"\s+")
Part = tuple[str, int, str, bool]  # feature, number of words, text or tag, whether in a labelled main element


class Reader:
    """Parts of a page in order: tags, and pieces of text with what they stand in.

    Elements that hold no article by their name or by a cue in class, id or role
    become one tag, their words are no candidates; forms count as elements with a
    cue. ``in_main`` tells whether a piece stands in an article or main element,
    which labels the page. In there a doubtful cue ("related-work", "header") takes
    an element out only if it has no paragraph or heading, or a third of its words
    are links.

    On a page without a readable such element, what a cue leaves out may be the
    page's wrapper ("has-sidebar"). Elements with a cue around the first article or
    main element without one are read if they hold no other, or over half of the
    words; where there is none, elements with a cue and over half of the words are.
    """

    def __init__(self, page: str):
        self.parts: list[Part] = []
        self.labelled = False
        cued, total = self._read(page, frozenset())
        if not self.labelled:
            # begin, words before, words up to its end, main elements likewise
            wrappers = [x for x in cued if 2 * (x[2] - x[1]) > total or x[4] - x[3] == 1]
            wrappers = [x for x in wrappers if x[3] == 0 < x[4]] or [x for x in wrappers if 2 * (x[2] - x[1]) > total]
            if wrappers:
                self.parts = []
                self._read(page, frozenset(x[0] for x in wrappers))

    def _read(self, page: str, spared: frozenset[int]) -> tuple[list[list[int]], int]:
        """Fills ``parts``; elements with a cue that begin at ``spared`` are read. Returns those with a cue, and the number of words."""
        cued: list[list[int]] = []
        opened: list[tuple[int, list[int]]] = []  # depth, element with a cue
        hard = None  # depth at which an element began that is left out without a cue
        total = mains = 0
        endless: set[str] = set()  # names without an end tag from here on

        def close(depth: int) -> None:
            while opened and opened[-1][0] >= depth:
                opened.pop()[1][2::2] = total, mains

        # open elements: name, whether in a main element, whether in a link, innermost block, whether that is a paragraph
        stack: list[tuple[str, bool, bool, str, bool]] = []
        places: dict[str, list[int]] = {}  # depths of the open elements of a name
        top = ("", False, False, "", False)
        doubtful: list[tuple[int, int, int, int, int]] = []  # depth; parts, words, words in links, paragraphs and headings before
        shown = linked = flow = 0

        def cut(depth: int) -> None:
            nonlocal skip, hard, top, shown, linked, flow
            skip, hard = (None if d is not None and depth <= d else d for d in (skip, hard))
            close(depth)
            for name, *_ in reversed(stack[depth:]):
                places[name].pop()
            del stack[depth:]
            top = stack[-1] if stack else ("", False, False, "", False)
            while doubtful and doubtful[-1][0] >= depth:
                _, parts, words, links, blocks = doubtful.pop()
                if flow == blocks or 3 * (linked - links) > shown - words:
                    del self.parts[parts:]

        skip = None  # depth at which a left-out element began
        at = 0
        while m := TOKENS.match(page, at):
            at = m.end()
            if (text := m["text"]) is not None:
                words = len(text.split()) if hard is None else 0
                total += words
                if skip is None:
                    shown += words
                    linked += words if top[2] else 0
                    self.parts.append((f"{top[3]} a" if top[2] else top[3], words, text, top[1]))
                continue
            name = (m["name"] or m["name2"] or "").lower()
            if not name:
                continue
            if m["end"] or m["end2"]:
                if places.get(name):
                    cut(places[name][-1])
                if skip is None:
                    self.parts.append((f"</{name}", 0, f"/{name}", top[1]))
                continue
            if name in CLOSES_P and top[4]:
                cut(places["p"][-1])  # an open paragraph ends here
            rest = m["rest"] if m["rest"] is not None else m["rest2"] or ""
            attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)} if rest else {}
            named = " ".join(attributes.get(k, "") for k in ("class", "id", "role", "itemprop"))
            main = name in ("article", "main") or bool(MAIN.search(named))
            inside = top[1]
            if skip is None:
                self.parts.append((f"<{name}", 0, name, inside))
                flow += name == "p" or name[:1] == "h" and name[1:].isdigit()
            if name in RAW:
                # its content is no markup: up to its end tag; without one it is empty, but for code, which goes to the end
                if name in endless or name in ("svg", "math") and rest.endswith("/"):
                    continue
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in ("script", "style"):
                    at = len(page)
                else:
                    endless.add(name)
                continue
            if name in VOID or rest.endswith("/"):
                continue
            hidden = "hidden" in rest.split() or re.search(r"display\s*:\s*none", attributes.get("style", ""))
            never = name in ASIDE and not (name == "header" and inside) or hidden
            cues = [] if OWN.search(named) else CUES.findall(named)
            doubt = inside and skip is None and bool(cues) and name not in FORMS and all(DOUBTFUL.fullmatch(c) for c in cues)
            cue = name in FORMS or bool(cues) and not doubt
            if never and hard is None:
                hard = len(stack)
            if hard is None and cue and not main and name != "body":
                cued.append([m.start(), total, total, mains, mains])
                opened.append((len(stack), cued[-1]))
            mains += hard is None and main and not cue
            out = never or (not main and name != "body" and cue and m.start() not in spared)
            if skip is None and out:
                skip = len(stack)
            if main and skip is None:
                self.labelled = True
            if doubt and not out:
                doubtful.append((len(stack), len(self.parts), shown, linked, flow))
            places.setdefault(name, []).append(len(stack))
            block = (top[3], top[4]) if name in INLINE else (f"{name}.{SPACES.split(attributes.get('class', '').strip())[0].lower()}", name == "p")
            top = (name, inside or main and skip is None, top[2] or name == "a", *block)
            stack.append(top)
        cut(0)
        close(0)
        return cued, total


def tallies(pages: list[str]) -> tuple[Counter, Counter]:
    """Words (and tags) by feature, inside and outside the main elements of the pages that have one."""
    inside, outside = Counter(), Counter()
    for page in pages:
        reader = Reader(page)
        if reader.labelled:
            for feature, words, _, main in reader.parts:
                (inside if main else outside)[feature] += 1 if feature[:1] == "<" else words
    return inside, outside


class Weights:
    """Log odds of a word by what it stands in; tags cost something, more where they stand outside articles."""

    #: Scores without labelled pages, and of features these never have.
    WORD, LINK, LOOSE, TAG = 3.0, -1.0, 0.5, -0.25
    FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td dd dt figcaption".split())

    def __init__(self, inside: dict[str, int], outside: dict[str, int]):
        self.inside, self.outside = inside, outside

    def of(self, feature: str) -> float:
        a, b = self.inside.get(feature, 0), self.outside.get(feature, 0)
        if feature[:1] == "<":
            return self.TAG - 2.0 * (b + 0.5) / (a + b + 1.0) if a + b else self.TAG
        if a + b < 20:
            if feature.endswith(" a"):
                return self.LINK
            return self.WORD if feature.split(".")[0] in self.FLOW else self.LOOSE
        return float(np.clip(np.log((a + 0.5) / (b + 0.5)), -5.0, 5.0))


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """Begin and end of the contiguous run with the largest sum, the first and longest of equals; empty if none is positive."""
    sums = np.r_[0.0, np.cumsum(scores)]
    low = np.minimum.accumulate(sums)
    gain = sums - low
    end = len(gain) - 1 - int(np.argmax(gain[::-1]))
    if gain[end] <= 0:
        return 0, 0
    return int(np.flatnonzero(sums[: end + 1] == low[end])[0]), end


def main_text(page: str, weights: Weights) -> str:
    """The blocks of the best run, references decoded, white space one space, one line each."""
    parts = Reader(page).parts
    scores = np.array([weights.of(f) * (w if f[:1] != "<" else 1) for f, w, _, _ in parts])
    begin, end = best_run(scores) if len(scores) else (0, 0)
    blocks, now = [], []
    for feature, _, text, _ in parts[begin:end]:
        if feature[:1] != "<":
            if weights.of(feature) > -2.5:
                now.append(text)
        elif (name := text.lstrip("/")) in INLINE or name in RAW:
            now.append(" " if name == "br" else "")
        else:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    clean = (SPACES.sub(" ", html.unescape(b)).strip() for b in blocks)
    return "\n".join(b for b in clean if b)


def fit(pages: DataFrame, source: str, sample: int = 4_000) -> Weights:
    """Weights from about ``sample`` pages taken by hash, of which those with an article or main element are labelled."""
    total = pages.count()
    part = F.pmod(F.xxhash64(col(source)), F.lit(1 << 30)) < int(min(1.0, sample / max(total, 1)) * (1 << 30))

    def count(batches):
        for batch in batches:
            inside, outside = tallies(batch.column(0).to_pylist())
            names = sorted({*inside, *outside})
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in (inside, outside))], names=["f", "a", "b"]
            )

    seen = pages.where(part).select(whole(source).alias("html")).mapInArrow(count, "f string, a long, b long")
    rows = seen.groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    return Weights({r["f"]: r["a"] for r in rows}, {r["f"]: r["b"] for r in rows})


def extract(df: DataFrame, source: str, weights: Weights, out: str = "text") -> DataFrame:
    """Adds ``out``, the main text of every page (the whole ``source``).

    Words score by the weights, tags below zero; the run with the largest sum is
    the article, less what stands in it without belonging there. Null and empty
    pages, and pages without a positive run, give an empty text. Broken, unclosed
    and cut markup is read as far as it goes. Repeated rows give equal texts; a
    column named ``out`` is replaced. Linear in the page's length.
    """

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, weights) for p in pages], dtype=object)

    return df.withColumn(out, text(whole(source)))
