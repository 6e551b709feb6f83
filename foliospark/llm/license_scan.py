"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Units of a document are the whole text, its paragraphs (between lines of white space only) and its
lines.  Normalising lower-cases A-Z and takes words of letters, digits and non-ASCII characters;
bigrams (with repeats) do not leave their unit.  Dice is 2 m / (a + b), with a and b bigrams in
unit and template and m in both.  As m is at most the smaller of a and b, a template can reach the
threshold t only if b lies in [a t / (2 - t), a (2 - t) / t]: sizes outside that range are pruned
before any overlap is counted, and units without a template's bigram never reach it.

Passages inside a unit, or over several, are windows of words of each template's own size, at every
place of the text: there Dice is m / b, and a passage reaches t if at most a share 1 - t of its
bigrams is other.  Bigrams that a matching unit shares with a template it matches are that unit's
and count for no window.  A window begins at every word; as the k-th bigram of a kind counts only
if fewer than its number in the template stand before it in the window, each occurrence adds one to
a run of beginnings, and running sums give m for all of them.  Texts with fewer than b t such
bigrams are pruned.  op1_license_scan's SQL has units alone, and the given tables no such passage.

One Arrow pass, no shuffle; only the templates (a fixed table) go to the tasks.  Nulls count as
empty texts, which match nothing; ties of the best score go to the smaller template id; repeated
rows each get their own result.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from foliospark.llm.common import map_texts, read, rest
from foliospark.llm.license_templates import templates
from foliospark.llm.words import ALNUM, LOWER, find_words, mix, text_buffers

THRESHOLD = 0.8
_BLANK = re.compile(rb"\n[\x20\x09-\x0D]*\n")
_FILTER_BITS = 20
FIELDS = [T.StructField("n_templates", T.LongType()), T.StructField("template", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("licenses", T.StringType())]


def _bigrams(hashes: np.ndarray) -> np.ndarray:
    """Hash of each pair of neighbouring words."""
    return mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])


class Templates:
    """Bigram counts of all templates as postings by bigram."""

    def __init__(self, rows: list[tuple[str, str, str]], threshold: float):
        rows = sorted(rows)
        self.names, self.licences, self.threshold = [r[0] for r in rows], [r[1] for r in rows], threshold
        data, offsets = text_buffers(pa.array([r[2] for r in rows], pa.large_string()))
        words = find_words(data, offsets, ALNUM, LOWER)
        post = []
        self.size = np.zeros(len(rows), dtype=np.int64)
        for k, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            grams, count = np.unique(_bigrams(words.hashes[1][a:b]), return_counts=True)
            self.size[k] = count.sum()
            post += [(int(g), k, int(c)) for g, c in zip(grams, count, strict=True)]
        post.sort()
        grams = np.array([p[0] for p in post], dtype=np.uint64)
        self.grams, first = np.unique(grams, return_index=True)
        self.first = np.append(first, len(post)).astype(np.int64)
        self.template = np.array([p[1] for p in post], dtype=np.int64)
        self.count = np.array([p[2] for p in post], dtype=np.int64)
        self.maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.maybe[(self.grams & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of grams that some template has, their numbers)."""
        some = np.flatnonzero(self.maybe[(grams & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.grams, grams[some]), len(self.grams) - 1)
        right = self.grams[at] == grams[some]
        return some[right], at[right]

    def match(self, unit: np.ndarray, gram: np.ndarray, unit_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, template, Dice) of all pairs at or over the threshold; unit and gram by bigram occurrence."""
        t = self.threshold
        pair, count = np.unique(unit * len(self.grams) + gram, return_counts=True)
        unit, gram = pair // len(self.grams), pair % len(self.grams)
        n = self.first[gram + 1] - self.first[gram]
        at = np.repeat(self.first[gram] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        unit, count, template = np.repeat(unit, n), np.repeat(count, n), self.template[at]
        a, b = unit_size[unit], self.size[template]
        fits = (b >= np.floor(a * t / (2 - t))) & (b <= np.ceil(a * (2 - t) / t))
        unit, template = unit[fits], template[fits]
        both = np.minimum(count[fits], self.count[at[fits]])
        key, back = np.unique(unit * len(self.names) + template, return_inverse=True)
        shared = np.bincount(back, both, minlength=len(key)).astype(np.int64)
        unit, template = key // len(self.names), key % len(self.names)
        dice = 2.0 * shared / (unit_size[unit] + self.size[template])
        good = dice >= t
        return unit[good], template[good], dice[good]

    def taken(self, unit: np.ndarray, gram: np.ndarray, hit_unit: np.ndarray, hit_template: np.ndarray) -> np.ndarray:
        """Which bigram occurrences a unit shares with a template that it matches."""
        out = np.zeros(len(gram), dtype=bool)
        at = np.flatnonzero(np.isin(unit, hit_unit))
        n = self.first[gram[at] + 1] - self.first[gram[at]]
        post = np.repeat(self.first[gram[at]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.isin(np.repeat(unit[at], n) * len(self.names) + self.template[post], hit_unit * len(self.names) + hit_template)
        out[np.repeat(at, n)[both]] = True
        return out

    def windows(self, row: np.ndarray, place: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, template, Dice) of the best window of each template's size in each row, at or over the threshold; rows and places ascend."""
        n = self.first[gram + 1] - self.first[gram]
        post = np.repeat(self.first[gram] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        key, place, gram = np.repeat(row, n) * len(self.names) + self.template[post], np.repeat(place, n), np.repeat(gram, n)
        pairs, back, total = np.unique(key, return_inverse=True, return_counts=True)
        able = total / self.size[pairs % len(self.names)] >= self.threshold
        some = np.flatnonzero(able[back])
        order = some[np.lexsort((place[some], gram[some], back[some]))]
        pair, place, gram, many = back[order], place[order], gram[order], self.count[post[order]]
        if not len(pair):
            return pair, pair, np.zeros(0)
        earlier = np.arange(len(pair)) - many  # as often as the template has the bigram, before this one
        same = (earlier >= 0) & (pair[earlier] == pair) & (gram[earlier] == gram)
        size = self.size[pairs[pair] % len(self.names)]
        begin = np.maximum(place - size, np.where(same, place[earlier], -(1 << 40))) + 1
        at, what = np.concatenate([begin, place + 1]), np.repeat(np.array([1, -1]), len(place))
        pair = np.concatenate([pair, pair])
        order = np.lexsort((what, at, pair))  # ends before beginnings of one place
        pair, shared = pair[order], np.cumsum(what[order])
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        template = pairs[pair[first]] % len(self.names)
        dice = np.maximum.reduceat(shared, first) / self.size[template]
        good = dice >= self.threshold
        return pairs[pair[first]][good] // len(self.names), template[good], dice[good]


@functools.lru_cache(maxsize=4)
def _compiled(rows: tuple, threshold: float) -> Templates:
    return Templates(list(rows), threshold)


def _edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte positions where lines begin, where paragraphs begin) inside the batch."""
    lines = np.flatnonzero(data == 0x0A) + 1
    raw = data.tobytes()
    blank = [m.end() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in _BLANK.finditer(raw, a, b)]
    return lines, np.array(blank, dtype=np.int64)


def scan(df: DataFrame, rows: list[tuple[str, str, str]] | None = None, threshold: float = THRESHOLD, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds n_templates (matched by any unit or window), template and dice of the best match (null if none) and licenses (distinct, sorted, comma-joined)."""
    fixed = tuple(templates() if rows is None else rows)

    def fn(_, data, offsets):
        known = _compiled(fixed, threshold)
        n = len(offsets) - 1
        words = find_words(data, offsets, ALNUM, LOWER)
        hashes = words.hashes[1]
        best, score, found = np.full(n, -1), np.zeros(n), {}
        if len(hashes) > 1:
            grams = _bigrams(hashes)
            place, number = known.find(grams)
            lines, blanks = _edges(data, offsets)
            free = words.row[place] == words.row[place + 1]
            hits = []
            for edges in (offsets[1:-1], np.union1d(lines, offsets[1:-1]), np.union1d(blanks, offsets[1:-1])):
                unit = np.searchsorted(edges, words.start, side="right")
                inside = unit[1:] == unit[:-1]
                size = np.bincount(unit[1:][inside], minlength=int(unit[-1]) + 1)
                keep = inside[place]
                u, k, dice = known.match(unit[place[keep]], number[keep], size)
                free[keep] &= ~known.taken(unit[place[keep]], number[keep], u, k)
                hits.append((words.row[np.searchsorted(unit, u)], k, dice))
            hits.append(known.windows(words.row[place[free]], place[free], number[free]))
            for row, k, dice in hits:
                for r, t, d in zip(row.tolist(), k.tolist(), dice.tolist(), strict=True):
                    found.setdefault(r, set()).add(t)
                    if d > score[r] or d == score[r] and t < best[r]:
                        best[r], score[r] = t, d
        return {
            "n_templates": pa.array([len(found.get(r, ())) for r in range(n)], pa.int64()),
            "template": pa.array([known.names[t] if t >= 0 else None for t in best.tolist()], pa.string()),
            "dice": pa.array([d if t >= 0 else None for t, d in zip(best.tolist(), score.tolist(), strict=True)], pa.float64()),
            "licenses": pa.array([",".join(sorted({known.licences[t] for t in found.get(r, ())})) for r in range(n)], pa.string()),
        }

    return map_texts(rest(df, *(f.name for f in FIELDS)), fn, FIELDS, text, carry)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence templates found in every document."""
    return scan(read(spark, sf_dir, "documents"), carry=["doc_id"])


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of op1_license_scan: the same units, bigrams and coefficients without pruning."""
    rows = ",\n".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in templates())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH t(template, license, body) AS (VALUES {rows}),
tw AS (SELECT template, license, regexp_extract_all({lower.format("body")}, '{word}') AS w FROM t),
tg AS (SELECT template, license, w[i] || ' ' || w[i + 1] AS g FROM (SELECT template, license, w, unnest(range(1, len(w))) AS i FROM tw)),
tc AS (SELECT template, license, g, count(*) AS n FROM tg GROUP BY ALL),
ts AS (SELECT template, any_value(license) AS license, sum(n) AS size FROM tc GROUP BY template),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT r, 0 AS kind, 0 AS u, text AS body FROM d
  UNION ALL SELECT r, 1, i, s[i] FROM (SELECT r, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)
  UNION ALL SELECT r, 2, i, s[i] FROM (SELECT r, string_split_regex(text, '\\n[\\x20\\x09-\\x0D]*\\n') AS s, unnest(range(1, len(string_split_regex(text, '\\n[\\x20\\x09-\\x0D]*\\n')) + 1)) AS i FROM d)),
uw AS (SELECT r, kind, u, regexp_extract_all({lower.format("body")}, '{word}') AS w FROM units),
ug AS (SELECT r, kind, u, len(w) - 1 AS size, w[i] || ' ' || w[i + 1] AS g FROM (SELECT r, kind, u, w, unnest(range(1, len(w))) AS i FROM uw)),
uc AS (SELECT r, kind, u, any_value(size) AS size, g, count(*) AS n FROM ug WHERE g IN (SELECT g FROM tc) GROUP BY r, kind, u, g),
m AS (SELECT uc.r, uc.kind, uc.u, tc.template, any_value(uc.size) AS a, sum(least(uc.n, tc.n)) AS shared FROM uc JOIN tc USING (g) GROUP BY uc.r, uc.kind, uc.u, tc.template),
hit AS (SELECT m.r, template, ts.license, 2.0::DOUBLE * shared / (a + ts.size) AS dice FROM m JOIN ts USING (template) WHERE 2.0::DOUBLE * shared / (a + ts.size) >= {threshold}),
best AS (SELECT r, count(DISTINCT template) AS n_templates, arg_min(template, {{'d': -dice, 't': template}}) AS template, max(dice) AS dice, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM hit GROUP BY r)
SELECT d.doc_id, coalesce(n_templates, 0)::BIGINT AS n_templates, template, dice, coalesce(licenses, '') AS licenses FROM d LEFT JOIN best USING (r)
"""
