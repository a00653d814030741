import random

import numpy as np
import pytest

from folio.llm import licenses as C
from folio.llm.license_templates import TEMPLATES
from tests.llm.rows import HARD, docs


def plain_matched(template, doc):
    """The matched tokens of the best local alignment without a band."""
    n, m = len(template), len(doc)
    score, matched = np.zeros((n + 1, m + 1), int), np.zeros((n + 1, m + 1), int)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            same = template[i - 1] == doc[j - 1]
            score[i, j], matched[i, j] = max((score[i - 1, j - 1] + (C.MATCH if same else C.DIFFER), matched[i - 1, j - 1] + same), (score[i - 1, j] + C.GAP, matched[i - 1, j]), (score[i, j - 1] + C.GAP, matched[i, j - 1]), (0, 0))
    return score.max()


def test_align_like_the_whole_table():
    rng = random.Random(1)
    for _ in range(60):
        t = [rng.randint(0, 9) for _ in range(rng.randint(8, 30))]
        body = [x for x in t if rng.random() > 0.1]
        for _ in range(2):
            body.insert(rng.randrange(len(body) + 1), 77)
        doc = [50] * 5 + body + [60] * 5
        matched, first, end = C.align(np.array(t, np.uint64), np.array(doc, np.uint64), 5)
        gaps = (end - first - matched) + (len(t) - matched)
        assert C.MATCH * matched + C.GAP * gaps <= plain_matched(t, doc) + C.MATCH * len(t)
        assert first >= 0 and end <= len(doc) and matched >= len(t) * 0.7


def test_finds_whole_changed_and_named_notices(spark):
    mit = " ".join(TEMPLATES["MIT"].split())
    changed = mit.replace("free of charge, ", "").replace("any person", "every single person").upper()
    texts = ["intro words here " + mit + " and an end", changed, "some text.\nLicensed under CC BY-NC 4.0.", "Released under the MIT License. x Released under the MIT License.", mit[:150], "licensed under the rules of the house", *HARD]
    frame = docs(spark, texts)
    got = C.scan(frame).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, "MIT"), (2, "MIT"), (3, "CC-BY-NC-4.0 (named)"), (4, "MIT (named)")}
    by = {(r.doc_id, r.first_token): r for r in got}
    assert by[1, 3].coverage == 1 and texts[0][by[1, 3].first_char :][: by[1, 3].n_chars] == mit
    assert 0.9 < next(r.coverage for r in got if r.doc_id == 2) < 1
    assert sorted(r.first_token for r in got if r.doc_id == 4) == [0, 6]
    assert C.scan(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        C.scan(frame, {"x": "two words"})


def test_shared_runs_share_a_fingerprint():
    rng = np.random.default_rng(1)
    for _ in range(200):
        run = rng.integers(0, 2**63, C.GRAM + C.WINDOWED - 1).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2**63, 9).astype(np.uint64), run, rng.integers(0, 2**63, 9).astype(np.uint64)]) for _ in range(2))
        assert np.intersect1d(C.fingerprints(a)[0], C.fingerprints(b)[0]).size


def test_the_token_that_names_the_license_must_match(spark):
    gpl = " ".join(TEMPLATES["GPL-3.0"].split())
    cc = "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."
    texts = ["x Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0.", "This work is licensed under the GNU General Public License, version 2.", cc, gpl, gpl.replace("version 3", "version 2"), gpl.replace("version 3", "version 7"), "Licensed under CC BY-XX 4.0."]
    got = {(r.doc_id, r.license.split(" ")[0]) for r in C.scan(docs(spark, texts)).collect()}
    assert got == {(1, "CC-BY-SA-4.0"), (2, "CC-BY-4.0"), (3, "GPL-2.0"), (4, "CC-BY-NC-4.0"), (5, "GPL-3.0"), (6, "GPL-2.0")}


def plain_table(template, doc):
    """The score of the best local alignment without a band, and the most tokens that one of that score matches."""
    n, m = len(template), len(doc)
    best = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            same = template[i - 1] == doc[j - 1]
            up, left, across = best[i - 1][j], best[i][j - 1], best[i - 1][j - 1]
            best[i][j] = max((across[0] + (C.MATCH if same else C.DIFFER), across[1] + same), (up[0] + C.GAP, up[1]), (left[0] + C.GAP, left[1]), (0, 0))
    return max(max(row) for row in best)


def test_align_like_the_best_of_the_whole_table():
    rng = random.Random(11)
    for _ in range(60):
        t = rng.sample(range(1000), rng.randint(20, 40))
        body = [x for x in t if rng.random() > 0.08]
        for _ in range(2):
            body.insert(rng.randrange(len(body) + 1), 5000 + rng.randint(0, 99))
        doc = rng.sample(range(2000, 3000), 5) + body + rng.sample(range(3000, 4000), 5)
        matched, first, end = C.align(np.array(t, np.uint64), np.array(doc, np.uint64), 5)
        assert matched == plain_table(t, doc)[1]
        assert doc[first] in t and doc[end - 1] in t


def test_query_like_full_alignment_with_all_templates(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    templates = {f"t{k}": rng.sample(vocabulary, n) for k, n in enumerate((20, 24, 33, 50, 80))}
    bodies = []
    for words in [*templates.values()] * 8:
        edits, body = rng.choice([0, 0.05, 0.1, 0.25, 0.4]), []
        for w in words:
            u = rng.random()
            body += [] if u < edits / 2 else [rng.choice(vocabulary)] if u < edits else [w]
        bodies.append([*rng.sample(vocabulary, 6), *body, *rng.sample(vocabulary, 6)])
    got = {}
    for r in C.scan(docs(spark, [" ".join(b) for b in bodies]), {n: " ".join(w) for n, w in templates.items()}).collect():
        got[r.doc_id, r.license] = round(r.coverage * len(templates[r.license]))
    want = {}
    for i, body in enumerate(bodies, 1):
        for name, words in templates.items():
            if (matched := plain_table(words, body)[1]) >= C.COVERAGE * len(words):
                want[i, name] = matched
    assert len(want) > 15 and got == want


def test_full_texts_and_spans_in_the_text_as_it_is(spark):
    gpl, mpl = TEMPLATES["GPL-3 (full text)"], TEMPLATES["MPL-2.0 (full text)"]
    mit = " ".join(TEMPLATES["MIT"].split())
    texts = ["İİİİİ start " + mit + " end", "Preface.\n" + gpl + "\nthe end", mpl[:2000], TEMPLATES["LGPL-2.1 (full text)"]]
    got = {(r.doc_id, r.license): r for r in C.scan(docs(spark, texts)).collect()}
    r = got[1, "MIT"]
    assert texts[0][r.first_char :][: r.n_chars] == mit
    assert {x for x in got if "full" in x[1]} == {(2, "GPL-3 (full text)"), (4, "LGPL-2.1 (full text)")} and got[2, "GPL-3 (full text)"].coverage > 0.99


def test_many_hits_are_few_alignments():
    shifts = np.sort(np.concatenate([np.full(50, 7), np.arange(100_000, 100_003), np.full(3, 900)]))
    assert C.candidates(shifts, 200) == [7] and C.least_hits(20) == 1 and C.least_hits(200) == 19 and C.least_hits(40) == 3


def test_notices_that_look_alike_are_told_apart(spark):
    names = ["GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"]
    texts = ["Some program.\n" + TEMPLATES[n].replace("\n", "\n * ") + " And more." for n in names]
    found = C.scan(docs(spark, texts)).collect()
    assert sorted((r.doc_id, r.license) for r in found) == sorted(enumerate(names, 1))
    assert all(r.coverage >= 0.8 for r in found)


def test_full_texts_name_no_other_license_and_take_no_time(spark):
    import time

    index = C.Index(sorted(TEMPLATES.items()))
    for name in ("GPL-3", "LGPL-2", "LGPL-3", "GFDL-1.3", "MPL-1.1", "Apache-2.0"):
        hashes = C.tokens().of("Before. " + TEMPLATES[f"{name} (full text)"] + " After.")
        began = time.process_time()
        found = index.matches(hashes)
        assert time.process_time() - began < 2.0
        family = name.split("-")[0]
        assert f"{name} (full text)" in [f[0] for f in found] and all(f[0].split("-")[0] == family for f in found), (name, found)


def test_spdx_marks(spark):
    texts = ["// SPDX-License-Identifier: MIT\nint x;", "# SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier:", "* SPDX-License-Identifier: GPL-2.0-or-later. x SPDX-License-Identifier: ISC", None]
    found = C.scan(docs(spark, texts)).collect()
    assert sorted((r.doc_id, r.license) for r in found) == [(1, "MIT (SPDX)"), (2, "Apache-2.0 (SPDX)"), (4, "GPL-2.0-or-later (SPDX)"), (4, "ISC (SPDX)")]
    for r in found:
        assert texts[r.doc_id - 1][r.first_char : r.first_char + r.n_chars].startswith("SPDX-License-Identifier:")
