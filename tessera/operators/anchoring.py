"""Placing quotes on pages: exact phrase, fuzzy window, sub-phrase, tile, or nothing."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# Thresholds of the fuzzy steps.
WINDOW_SHARE, SUB_MIN, SUB_MAX, PAD = 0.85, 3, 8, 8.0
ANCHOR = "id string, status string, method string, x0 double, y0 double, x1 double, y1 double"


def tokens_of(text: str | None) -> list[str]:
    """Folded lower-case tokens; a hyphen inside a word parts it, a sign before a number stays."""
    import re
    import unicodedata

    t = unicodedata.normalize("NFKC", text or "").translate({**{ord(c): "-" for c in T.DASHES}, **{ord(c): None for c in T.INVISIBLE}, **{ord(c): "'" for c in "‘’‚‛′"}, **{ord(c): '"' for c in "“”„‟″"}, **{ord(c): "o" for c in "Øø"}})
    return re.sub(r"(?<=\w)-(?=\w)", " ", t.replace("''", '"')).lower().split()


class Page:
    """A page's token stream with the word that each token came from."""

    def __init__(self, words: pd.DataFrame):
        self.rects = words[["x0", "y0", "x1", "y1"]].to_numpy(float)
        self.tokens, self.word = [], []
        for i, t in enumerate(words["text"]):
            for tok in tokens_of(t):
                self.tokens.append(tok)
                self.word.append(i)
        self.at: dict[str, list[int]] = {}
        for i, t in enumerate(self.tokens):
            self.at.setdefault(t, []).append(i)

    def find(self, query: list[str]) -> list[int]:
        m = len(query)
        return [i for i in self.at.get(query[0], ()) if self.tokens[i : i + m] == query] if query else []

    def rect(self, start: int, m: int) -> tuple[float, float, float, float]:
        r = self.rects[sorted(set(self.word[start : start + m]))]
        return r[:, 0].min(), r[:, 1].min(), r[:, 2].max(), r[:, 3].max()

    def windows(self, query: list[str]) -> list[int]:
        """Starts of the windows of the query's length with the largest multiset overlap, at WINDOW_SHARE or more."""
        m, want = len(query), Counter(query)
        if not m or m > len(self.tokens):
            return []
        have = Counter(t for t in self.tokens[:m] if t in want)
        got = sum((have & want).values())
        best, starts = WINDOW_SHARE * m, []
        for i in range(len(self.tokens) - m + 1):
            if got > best or got == best and starts or got >= best and not starts:
                starts = [*starts, i] if starts and got == best else [i]
                best = got
            if i + m < len(self.tokens):
                out, new = self.tokens[i], self.tokens[i + m]
                if out in want:
                    got -= have[out] <= want[out]
                    have[out] -= 1
                if new in want:
                    have[new] += 1
                    got += have[new] <= want[new]
        return starts

    def sub_phrase(self, query: list[str]) -> tuple[list[int], int]:
        """Places of the longest part of the query that occurs; of equals the one with the rarest token."""
        for n in range(min(len(query) - 1, SUB_MAX, len(self.tokens)), SUB_MIN - 1, -1):
            found = [(min(len(self.at[t]) for t in query[s : s + n]), hits) for s in range(len(query) - n + 1) if (hits := self.find(query[s : s + n]))]
            if found:
                return min(found, key=lambda x: x[0])[1], n
        return [], 0


def cell(rect, w: float, h: float, rows: int, cols: int) -> tuple[int, int]:
    cx, cy = (rect[0] + rect[2]) / 2, (rect[1] + rect[3]) / 2
    return min(rows - 1, max(0, int(cy / (h / rows)))), min(cols - 1, max(0, int(cx / (w / cols))))


def place(page: Page, quote: str | None, tile, w: float, h: float, rows: int, cols: int, overlap: float = 0.08) -> tuple:
    def pick(starts: list[int], m: int) -> tuple[int, bool]:
        if len(starts) > 1 and tile is not None:
            inside = [s for s in starts if cell(page.rect(s, m), w, h, rows, cols) == tile]
            if inside:
                return inside[0], len(inside) == 1
        return starts[0], len(starts) == 1

    def padded(start: int, m: int) -> tuple:
        x0, y0, x1, y1 = page.rect(start, m)
        return max(0.0, x0 - PAD), max(0.0, y0 - PAD), min(w, x1 + PAD), min(h, y1 + PAD)

    if not (quote or "").strip():
        if tile is None:
            return "UNANCHORED", "no_quote_no_tile", None, None, None, None
        cw, ch = w / cols, h / rows
        r, c = tile
        return "TILE", "tile", max(0.0, c * cw - cw * overlap), max(0.0, r * ch - ch * overlap), min(w, (c + 1) * cw + cw * overlap), min(h, (r + 1) * ch + ch * overlap)
    query = tokens_of(quote)
    if query and (hits := page.find(query)):
        start, sure = pick(hits, len(query))
        return "EXACT", "exact" if sure else "exact_ambiguous", *padded(start, len(query))
    if hits := page.windows(query):
        return "FUZZY", "fuzzy_window", *padded(pick(hits, len(query))[0], len(query))
    hits, n = page.sub_phrase(query)
    if hits:
        return "FUZZY", "fuzzy_subphrase", *padded(pick(hits, n)[0], n)
    return "UNANCHORED", "quote_not_found", None, None, None, None


def anchor_quotes(findings: DataFrame, words: DataFrame, page: str = "page") -> DataFrame:
    """``findings``: page, id, quote, tile_row, tile_col, page_w, page_h, rows, cols; ``words``: page, ordinal,
    x0, y0, x1, y1, text. One row per finding. A page's words and findings meet in one task (a page is small)."""

    def run(found: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        p = Page(own.sort_values("ordinal"))
        out = []
        for f in found.itertuples():
            r, c = f.tile_row, f.tile_col
            tile = (int(r), int(c)) if r == r and c == c and r is not None and c is not None and 0 <= r < f.rows and 0 <= c < f.cols else None
            out.append((str(f.id), *place(p, f.quote, tile, f.page_w, f.page_h, int(f.rows), int(f.cols))))
        return pd.DataFrame(out, columns=["id", "status", "method", "x0", "y0", "x1", "y1"])

    return findings.groupBy(page).cogroup(words.groupBy(page)).applyInPandas(run, ANCHOR)


def find_phrase(pages: DataFrame, text: str, phrase) -> DataFrame:
    """Adds n_found: non-overlapping, case-insensitive occurrences of the phrase."""
    return pages.withColumn("n_found", T.occurrences(F.col(text), phrase))


#: Quotes up to this count are sent to the executors (they are counted first); more meet the texts by three inner words.
BROADCAST_QUOTES = 1_000


def containing(texts: DataFrame, quotes: DataFrame, text: str, quote: str, most: int = BROADCAST_QUOTES) -> DataFrame:
    """Pairs of texts and the quotes that stand in them, all columns of both.

    A few quotes are looked up one by one. With more, a quote of five words or more is first joined to the texts by
    its second to fourth words, which are whole words wherever the quote stands; shorter ones must be few.
    Empty quotes stand nowhere."""
    quotes = quotes.where(F.col(quote) != "")
    hit = F.col(text).contains(F.col(quote))
    if quotes.count() <= most:
        return texts.join(F.broadcast(quotes), hit)
    words = F.split(F.col(quote), " ")
    long_ = quotes.where(F.size(words) >= 5)
    short = quotes.where(F.size(words) < 5)
    if (n := short.count()) > most:
        raise ValueError(f"{n} quotes of under five words; {most} at most")
    gram = lambda w, i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    keyed = long_.withColumn("__gram", gram(words, F.lit(1)))
    own = F.split(F.col(text), " ")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(own) - 3)), lambda i: gram(own, i)))
    found = texts.withColumn("__gram", F.explode(grams)).join(keyed, "__gram").where(hit).drop("__gram")
    return found.unionByName(texts.join(F.broadcast(short), hit))
