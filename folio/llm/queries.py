"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import collocations, decontaminate, language_id, licenses, merkle, perplexity, pii, ppm, quality, repeats, sentencepiece_scan, sharding, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": sentencepiece_scan.op1_sentencepiece,
    "op2_simhash": simhash.op2_simhash,
    "op3_pii": pii.op3_pii,
    "op5_sharding": sharding.op5_sharding,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op8_quality": quality.op8_quality,
    "op4_ppm": ppm.op4_ppm,
    "op10_perplexity": perplexity.op10_perplexity,
    "op7_language_id": language_id.op7_language_id,
    "op9_licenses": licenses.op9_licenses,
    "op11_merkle": merkle.op11_merkle,
    "op12_collocations": collocations.op12_collocations,
    "op13_repeats": repeats.op13_repeats,
}

#: CRC-32 in SQL: its table from its polynomial, then a step for each byte.
_CRC_TABLE = "with t as (select list(c order by i) as t from (select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as c from range(256) r(i)))"
_CRC = _CRC_TABLE + """,
  d as (select doc_id, octet_length(encode(coalesce(text, ''))) + 8 as size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda y: ('0x' || y)::bigint) as bytes from documents),
  z as (select doc_id, size::bigint as size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t.t[xor(c & 255, x) + 1]), 4294967295), 4294967295)::bigint as text_crc32 from d, t)"""



def _climb(name: str, levels: int, fan: int = 8) -> str:
    """Views {name}1 to {name}{levels} over {name}0 (g, i, n, d): each level's digests with their siblings to the left and right."""
    views = []
    for k in range(levels + 1):
        if k:
            views.append(f"{name}{k} as (select g, i // {fan} as i, (any_value(n) + {fan - 1}) // {fan} as n, case when any_value(n) = 1 then any_value(d) else sha256(string_agg(d, '' order by i)) end as d from {name}{k - 1} group by g, i // {fan})")
        side = f"coalesce(string_agg(d, '') over (partition by g, i // {fan} order by i rows between %s), '')"
        views.append(f"{name}s{k} as (select g, i, n > 1 as more, {side % 'unbounded preceding and 1 preceding'} as l, {side % '1 following and unbounded following'} as r from {name}{k})")
    return ", ".join(views)


def _merkle(levels: int = 6, top: int = 3, fan: int = 8) -> str:
    """Leaves, proofs and folds level by level, for up to fan ** levels rows of a language and fan ** top languages."""
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::varchar, ''))), '..'), lambda y: ('0x' || y)::bigint), lambda c, x: xor(c >> 8, t.t[xor(c & 255, x) + 1]), 4294967295), 4294967295)"
    steps, last = [], "v"
    for k in range(levels):
        steps.append(f"v{k} as (select {last}.* replace (case when more then sha256(l || x || r) else x end as x, proof || l || r as proof) from {last} join as{k} s on s.g = {last}.g and s.i = {last}.i // {fan**k})")
        last = f"v{k}"
    steps.append(f"w as (select {last}.*, b0.i as top from {last} join b0 on b0.of = {last}.g)")
    last = "w"
    for k in range(top):
        steps.append(f"w{k} as (select {last}.* replace (case when more then sha256(l || x || r) else x end as x, proof || l || r as proof) from {last} join bs{k} s on s.i = {last}.top // {fan**k})")
        last = f"w{k}"
    return f"""{_CRC_TABLE}, leaves as (select doc_id, coalesce('1' || lang, '0') as g, {leaf('text')} as leaf, case when {crc} % 3 = 0 then {leaf(lower)} else {leaf('text')} end as x from documents, t),
  v as (select *, '' as proof, row_number() over (partition by g order by doc_id nulls first, leaf, x) - 1 as i from leaves),
  a0 as (select g, i, count(*) over (partition by g) as n, leaf as d from v), {_climb("a", levels)},
  b0 as (select '' as g, row_number() over (order by g) - 1 as i, count(*) over () as n, d, g as of from a{levels}), {_climb("b", top)}, {", ".join(steps)}
  select doc_id, leaf, b0.d as subroot, b{top}.d as root, sha256(proof) as proof_sha256, x as folded_root, x = b{top}.d as verified from {last} join b0 on b0.of = {last}.g, b{top}"""


def _collocations(words: int = 5, least: int = 100, top: int = 2000) -> str:
    """Every n-gram of every piece, counted as text."""
    return rf"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
  w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p), t as (select lang, sum(len(ws))::bigint as n from w group by lang),
  g as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, range(1, {words + 1}) s(k))),
  f as (select lang, k::int as k, phrase, count(*) as f from g group by lang, k, phrase having count(*) >= {least}),
  c as (select lang, phrase, f, k, string_split(phrase, ' ') as ws from f where k > 1),
  u as (select lang, phrase, f, j, array_to_string(ws[1:j], ' ') as x, array_to_string(ws[j + 1:], ' ') as y from (select *, unnest(range(1, k)) as j from c)),
  s as (select u.lang, u.phrase, u.f as a, j, l.f as l, r.f as r, n, (1000::hugeint * u.f * n) // (l.f::hugeint * r.f) as score from u join f l on l.lang = u.lang and l.phrase = x join f r on r.lang = u.lang and r.phrase = y join t on t.lang = u.lang),
  b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
  i as (select lang, array_to_string(ws[b:b + m - 1], ' ') as phrase, max(f) as around from (select *, unnest(range(1, k - m + 2)) as b from (select *, unnest(range(2, k)) as m from c)) group by 1, 2),
  o as (select b.* from b left join i on i.lang = b.lang and i.phrase = b.phrase where around is null or around < a),
  d as (select lang, phrase, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, a, l, r, n, score::bigint as score from o qualify rank <= {top})
  select lang, rank, phrase, a, l, r, n, score from d"""


def _repeats(least: int = 50) -> str:
    """Every string of `least` bytes as hex text with its smallest document, then the stretches that such strings cover."""
    return f"""with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
  p as (select r, doc_id, h, unnest(range(0, length(h) // 2 - {least} + 1)) as i from d), w as (select r, doc_id, i, substring(h, 2 * i + 1, {2 * least}) as s from p),
  m as (select s, min(doc_id) as least from w group by s having count(distinct doc_id) > 1),
  c as (select r, i from w join m using (s) where w.doc_id > m.least),
  o as (select r, i, sum(case when before is null or i > before + {least} then 1 else 0 end) over (partition by r order by i) as g from (select r, i, lag(i) over (partition by r order by i) as before from c)),
  g as (select r, g, min(i) as b, max(i) + {least} as e from o group by r, g),
  k as (select r, lag(e, 1, 0) over (partition by r order by b) as f, b, e, row_number() over (partition by r order by b desc) as last from g),
  j as (select d.r, string_agg(substring(h, 2 * f + 1, 2 * (b - f)), '' order by b) || substring(any_value(h), 2 * max(e) + 1) as kept, sum(e - b) as removed, count(*) as spans from d join k on k.r = d.r group by d.r)
  select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join j on j.r = d.r"""


ORACLES: dict[str, str] = {
    "op13_repeats": _repeats(),
    "op12_collocations": _collocations(),
    "op11_merkle": _merkle(),
    "op5_sharding": f"""{_CRC}, p as (select *, sum(size) over (order by doc_id) - size as first_byte, sum(size) over () as total from z)
        select doc_id, size, text_crc32, 'bytes' as law, (first_byte * 24 // total)::int as shard, row_number() over (partition by first_byte * 24 // total order by doc_id) - 1 as slot, null::int as grown_shard, first_byte::bigint as first_byte from p""",
}
