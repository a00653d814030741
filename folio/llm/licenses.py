"""License scans: winnowed fingerprints find candidate templates, and banded alignment measures the match.

Each template and each document is a sequence of token hashes. Hashes of GRAM consecutive tokens are winnowed: of
every WINDOWED in a row the least is kept, so a template and a document that share GRAM + WINDOWED - 1 tokens in a
row share a kept fingerprint. An inverted index from fingerprints to places in templates gives candidates; around
each, template and document are aligned by local alignment within a band, which allows for tokens changed, added and
left out, and gives what share of the template is matched and where it stands in the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import read, whole
from folio.llm.decontaminate import tokens
from folio.llm.license_templates import REQUIRED, TEMPLATES

GRAM, WINDOWED = 3, 2
#: The share of a template's tokens that must match.
COVERAGE = 0.8
#: Templates of fewer tokens must match exactly, as one token tells licenses apart.
SHORT = 20
#: Half the width of the band, and its growth with the template.
BAND, BAND_SHARE = 4, 0.1
#: Weights of a token that matches, one that differs, and one that only one side has.
MATCH, DIFFER, GAP = 2, -1, -1
ONE = 1 << 20
#: Tokens of templates that go to the tasks at once.
BLOCK_TOKENS = 500_000


def fingerprints(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed fingerprints, and the places of their first tokens."""
    n = len(hashes) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for k in range(GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    grams ^= grams >> np.uint64(31)
    if n < WINDOWED:
        return grams, np.arange(n)
    least = np.lib.stride_tricks.sliding_window_view(grams, WINDOWED).argmin(1) + np.arange(n - WINDOWED + 1)
    places = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return grams[places], places


def band_of(n: int) -> int:
    return BAND + int(BAND_SHARE * n)


def least_hits(n: int) -> int:
    """How many fingerprints a template of n tokens shares with a match of enough coverage.

    An edit spoils GRAM grams at most, and e edits leave e + 1 runs of grams, each of which shares a fingerprint for
    every WINDOWED of its grams at least, rounded down. A match may have 1 - COVERAGE of n edits; more than that, as
    many tokens added, may leave it no candidate.
    """
    edits = n - int(np.ceil(COVERAGE * n - 1e-9))
    return max(1, -(-(n - GRAM + 1 - GRAM * edits - (WINDOWED - 1) * (edits + 1)) // WINDOWED))


def candidates(shifts: np.ndarray, n: int) -> list[int]:
    """Diagonals, out of sorted ones of hits, to align a template of n tokens along: with enough hits in their band.

    Two that lie less than half a band apart have the same band, all but for its edges, so one is enough.
    """
    band, out = band_of(n), []
    enough = np.searchsorted(shifts, shifts + band, side="right") - np.searchsorted(shifts, shifts - band) >= least_hits(n)
    for shift in shifts[enough].tolist():
        if not out or shift - out[-1] > band // 2:
            out.append(shift)
    return out


def align(template: np.ndarray, doc: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(matched, first, end) of the best local alignment of template[i] with doc[i + shift + d], |d| within the band.

    Of alignments of one score, one that matches most counts: scores are taken ONE times, and a match adds 1.
    """
    match, differ, gap = MATCH * ONE + 1, DIFFER * ONE, GAP * ONE
    band = band_of(len(template))
    width = 2 * band + 1
    offsets = np.arange(width)
    score = np.zeros((len(template) + 1, width), np.int64)
    same = np.zeros((len(template), width), bool)
    for i in range(len(template)):
        at = i + shift - band + offsets
        inside = (at >= 0) & (at < len(doc))
        same[i] = inside & (doc[np.clip(at, 0, len(doc) - 1)] == template[i])
        best = np.maximum(score[i] + np.where(same[i], match, differ), 0)
        best[:-1] = np.maximum(best[:-1], score[i, 1:] + gap)
        best[~inside] = 0
        score[i + 1] = np.maximum(best, np.maximum.accumulate(best - gap * offsets) + gap * offsets)
        score[i + 1][~inside] = 0
    i, d = np.unravel_index(int(score.argmax()), score.shape)
    matched, end, first = 0, int(i - 1 + shift - band + d + 1), 0
    while i > 0 and score[i, d] > 0:
        first = int(i - 1 + shift - band + d)
        if d > 0 and score[i, d] == score[i, d - 1] + gap:
            d -= 1
        elif score[i, d] == max(0, score[i - 1, d] + (match if same[i - 1, d] else differ)):
            matched += bool(same[i - 1, d])
            i -= 1
        else:
            i, d = i - 1, d + 1
    return matched, first, end


def _has_runs(hashes: np.ndarray, runs: list[np.ndarray]) -> bool:
    """Whether each of the runs stands somewhere in hashes."""
    return all(any(np.array_equal(hashes[x : x + len(r)], r) for x in np.flatnonzero(hashes[: len(hashes) - len(r) + 1] == r[0])) for r in runs)


class Index:
    def __init__(self, templates: list[tuple[str, str]]) -> None:
        self.names = [n for n, _ in templates]
        self.texts = [tokens().of(t) for _, t in templates]
        runs = (REQUIRED.get(n, ()) for n in self.names)
        self.required = [[tokens().of(x) for x in ((r,) if isinstance(r, str) else r)] for r in runs]
        self.places: dict[int, list[tuple[int, int]]] = {}
        for k, hashes in enumerate(self.texts):
            for fp, at in zip(*(x.tolist() for x in fingerprints(hashes)), strict=True):
                self.places.setdefault(fp, []).append((k, at))
        self.keys = np.array(sorted(self.places), np.uint64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys >> np.uint64(42)] = True

    def matches(self, hashes: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first token, end token) of every match; of those that overlap, a template's best."""
        found, places = fingerprints(hashes)
        near = self.maybe[found >> np.uint64(42)]
        shifts: dict[int, list[int]] = {}
        for fp, p in zip(found[near].tolist(), places[near].tolist(), strict=True):
            for k, at in self.places.get(fp, ()):
                shifts.setdefault(k, []).append(p - at)
        out = []
        for k, of in shifts.items():
            spans = []
            n, required = len(self.texts[k]), self.required[k]
            if n < SHORT:
                spans = [(1.0, x, x + n) for x in sorted(set(of)) if x >= 0 and np.array_equal(hashes[x : x + n], self.texts[k])]
            elif len(of) >= least_hits(n) and _has_runs(hashes, required):
                shifts_of = candidates(np.sort(np.array(of)), n)
                # What stands there word for word needs no alignment, and what would overlap it can't win.
                exact = [x for x in sorted(set(of)) if x >= 0 and np.array_equal(hashes[x : x + n], self.texts[k])]
                spans = [(1.0, x, x + n) for x in exact if _has_runs(hashes[x : x + n], required)]
                room = COVERAGE * n - band_of(n)
                for shift in (s for s in shifts_of if all(abs(s - x) >= room for x in exact)):
                    matched, first, end = align(self.texts[k], hashes, shift)
                    if matched >= COVERAGE * n and _has_runs(hashes[first:end], required):
                        spans.append((matched / n, first, end))
            taken: list[tuple[float, int, int]] = []
            for span in sorted(spans, key=lambda s: (-s[0], s[1])):
                if all(span[2] <= t[1] or span[1] >= t[2] for t in taken):
                    taken.append(span)
            out += [(self.names[k], *s) for s in taken]
        return sorted(out, key=lambda x: (x[2], x[0]))


#: The mark of a file's license by its identifier.
MARK = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9][A-Za-z0-9.+-]*)")


def marks(text: str) -> list[tuple[str, float, int, int, int, int]]:
    """(license, 1, first token, end token, first character, end) of each SPDX mark: the identifier, as it stands there, is the license."""
    found = [(m.group(1).rstrip(".") + " (SPDX)", *m.span()) for m in MARK.finditer(text)]
    if not found:
        return []
    memory = tokens()
    begins = np.array([m.start() for m in re.finditer(r"\S+", text) if memory[m.group().lower()]])
    return [(name, 1.0, *(int(x) for x in np.searchsorted(begins, (a, b))), a, b) for name, a, b in found]


def _characters(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where spans of tokens begin and end in text."""
    memory = tokens()
    at = [m.span() for m in re.finditer(r"\S+", text) if memory[m.group().lower()]]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def _scan(sent, spdx: bool):
    names = ["doc_id", "license", "coverage", "first_token", "n_tokens", "first_char", "n_chars"]
    types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memory = sent.value, tokens()
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = value.as_py()
                if found := index.matches(memory.of(text)):
                    at = _characters(text, [x[2:] for x in found])
                    rows += [(doc_id, name, share, a, b - a, c, d - c) for (name, share, a, b), (c, d) in zip(found, at, strict=True)]
                if spdx:
                    rows += [(doc_id, name, share, a, b - a, c, d - c) for name, share, a, b, c, d in marks(text)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, coverage, first_token, n_tokens, first_char, n_chars of each match of a template in docs.

    Templates have GRAM tokens at least (ValueError otherwise) and are sent to the tasks in blocks of BLOCK_TOKENS,
    with a pass over docs for each. Null and empty texts match nothing, repeated rows match each, a null id is reported
    as null, and an empty table gives no rows. A document is read whole, and held by its task. Of a template's matches
    that overlap, the one of most coverage counts, and then the first; matches of different templates are all
    reported. `SPDX-License-Identifier: X` gives `X (SPDX)`. Characters are those of the text as it is. Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long"), whole("text").alias("text"))
    out, block, held = None, [], 0
    items = sorted((TEMPLATES if templates is None else templates).items())
    for k, (name, text) in enumerate(items):
        n = len(tokens().of(text))
        if n < GRAM:
            raise ValueError(f"template {name} has less than {GRAM} tokens")
        block.append((name, text))
        held += n
        if held >= BLOCK_TOKENS or k == len(items) - 1:
            sent = docs.sparkSession.sparkContext.broadcast(Index(block))
            found = texts.mapInArrow(_scan(sent, out is None), "doc_id long, license string, coverage double, first_token long, n_tokens long, first_char long, n_chars long")
            out, block, held = found if out is None else out.union(found), [], 0
    return out


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`scan` of all documents for the templates of license_templates."""
    return scan(read(spark, sf_dir, "documents"))
