"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation in SQL expressions.

Validated numbers (payment cards by their check digit, US social security numbers, phone numbers, IPv4 addresses),
calendar dates and e-mail addresses are read as lists of small values, each below a radix of its own (digits 10,
letters 26, octets 256). A list's halves take turns: each value of one half moves, modulo its radix, by a keyed
hash of the other half. This is a permutation of all lists of that format, so equal values get equal pseudonyms in
all documents, different values never meet, and a card stays a valid card and a date a valid date. What does not
validate stays as it is. No Python runs on the rows, and no row moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import read

ROUNDS = 8
#: Dates from 1900-01-01 on, as many days as the product of the two radices.
FIRST_DAY, DAY_RADICES = "1900-01-01", (250, 292)

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,252}[A-Za-z0-9])?"
PHONE = r"(?<![\d+])(?:\+?1[ .-]?)?\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|(?<![\d+.-])(?:\+?1[ .-])?\d{3}([ .-])\d{3}\1\d{4}(?![\d-])|(?<![\d+])\+\d{10,15}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{4})(?!\d)"
#: In this order, so \1 and \2 count over all of it.
ANY = "|".join((EMAIL, PHONE, SSN, IP, DATE, CARD))
#: Date formats, tried in this order; 12/11/2013 is read month first.
DATES = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy")


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(values: str, radices: str, key: str, tweak: str) -> str:
    """SQL for the permuted list of values (array<bigint>), each below the radix at its place."""

    def moved(half: str, other: str, offset: str) -> str:
        seen = f"array_join(transform(s.{other}, y -> cast(y as string)), ',')"
        number = f"cast(conv(substr(sha2(concat_ws('|', {_text(key)}, '{tweak}', r, i, {seen}), 256), 1, 12), 16, 10) as bigint)"
        return f"transform(s.{half}, (x, i) -> (x + {number}) % element_at(f.radices, {offset} + i + 1))"

    start = "named_struct('a', slice(f.v, 1, shiftright(size(f.v) + 1, 1)), 'b', slice(f.v, shiftright(size(f.v) + 1, 1) + 1, size(f.v)))"
    step = f"if(r % 2 = 1, named_struct('a', {moved('a', 'b', '0')}, 'b', s.b), named_struct('a', s.a, 'b', {moved('b', 'a', 'shiftright(size(f.v) + 1, 1)')}))"
    whole = f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {step}, s -> concat(s.a, s.b))"
    return f"transform(array(named_struct('v', {values}, 'radices', {radices})), f -> {whole})[0]"


def _digits(text: str) -> str:
    return f"transform(split({text}, ''), d -> cast(d as bigint))"


def _joined(values: str) -> str:
    return f"array_join(transform({values}, d -> cast(d as string)), '')"


def _same(text: str, radix: int) -> str:
    return f"transform(split({text}, ''), d -> {radix}L)"


def _refill(match: str, digits: str) -> str:
    """match with its digits replaced, in order."""
    return f"array_join(zip_with(split({match}, '[0-9]', -1), split({digits}, ''), (p, d) -> concat(p, coalesce(d, ''))), '')"


def _luhn(digits: str) -> str:
    at = f"cast(substr({digits}, length({digits}) - k, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, k) -> t + if(k % 2 = 1, 2 * {at} - if({at} > 4, 9, 0), {at}))"


def _card(key: str) -> str:
    # The first digit (the kind of card) stays, the last is the new check digit.
    body = f"concat(substr(n, 1, 1), {_joined(feistel(_digits('substr(n, 2, length(n) - 2)'), _same('substr(n, 2, length(n) - 2)', 10), key, 'card'))}, '0')"
    new = f"transform(array({body}), c -> concat(substr(c, 1, length(c) - 1), cast((10 - {_luhn('c')} % 10) % 10 as string)))[0]"
    return f"if({_luhn('n')} % 10 = 0, {_refill('m', new)}, m)"


def _phone(key: str) -> str:
    # The last ten digits; what stands before them is a country code.
    new = f"concat(substr(n, 1, length(n) - 10), {_joined(feistel(_digits('right(n, 10)'), _same('right(n, 10)', 10), key, 'phone'))})"
    return _refill("m", new)


def _ssn(key: str) -> str:
    area, group, serial = (f"cast(substr(n, {a}, {b}) as bigint)" for a, b in ((1, 3), (4, 2), (6, 4)))
    values = f"array({area} - 1 - if({area} > 666, 1, 0), {group} - 1, {serial} - 1)"
    new = f"transform(array({feistel(values, 'array(898L, 99L, 9999L)', key, 'ssn')}), v -> concat(lpad(cast(v[0] + 1 + if(v[0] >= 665, 1, 0) as string), 3, '0'), lpad(cast(v[1] + 1 as string), 2, '0'), lpad(cast(v[2] + 1 as string), 4, '0')))[0]"
    return f"if({area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0, {_refill('m', new)}, m)"


def _ip(key: str) -> str:
    octets = "transform(split(m, '[.]'), o -> cast(o as bigint))"
    new = f"array_join(transform({feistel(octets, 'array(256L, 256L, 256L, 256L)', key, 'ip')}, o -> cast(o as string)), '.')"
    return f"if(forall({octets}, o -> o < 256), {new}, m)"


def _date(key: str) -> str:
    days = DAY_RADICES[0] * DAY_RADICES[1]

    def written(form: str) -> str:
        day = f"cast(datediff(try_to_timestamp(m, '{form}'), date'{FIRST_DAY}') as bigint)"
        values = f"array({day} div {DAY_RADICES[1]}L, {day} % {DAY_RADICES[1]}L)"
        new = f"transform(array({feistel(values, f'array({DAY_RADICES[0]}L, {DAY_RADICES[1]}L)', key, 'date')}), v -> date_format(date_add(date'{FIRST_DAY}', cast(v[0] * {DAY_RADICES[1]} + v[1] as int)), '{form}'))[0]"
        return f"if({day} between 0 and {days - 1}, {new}, m)"

    first, *rest = [f"when m rlike '{'^' + f.replace('yyyy', '[0-9]{4}').replace('MM', '[0-9]{2}').replace('dd', '[0-9]{2}').replace('.', '[.]') + '$'}' then {written(f)}" for f in DATES]
    return f"case {first} {' '.join(rest)} else m end"


def _email(key: str) -> str:
    # All but the last part of the domain; other characters than letters and digits stay.
    values = "transform(split(n, ''), c -> case when c between 'a' and 'z' then cast(ascii(c) - 97 as bigint) when c between '0' and '9' then cast(c as bigint) else 0L end)"
    radices = "transform(split(n, ''), c -> case when c between 'a' and 'z' then 26L when c between '0' and '9' then 10L else 1L end)"
    one = "case when c between 'a' and 'z' then char(cast(97 + v as int)) when c between 'A' and 'Z' then char(cast(65 + v as int)) when c between '0' and '9' then cast(v as string) else c end"
    body = "regexp_extract(m, '^(.*)[.]', 1)"
    new = f"array_join(zip_with(split({body}, ''), {feistel(values, radices, key, 'email')}, (c, v) -> {one}), '')"
    bound = f"transform(array(lower({body})), n -> {new})[0]"
    return f"if(m rlike '@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+$', concat({bound}, regexp_extract(m, '([.][^.]*)$', 1)), m)"


def _pseudonym(key: str) -> str:
    """SQL for the pseudonym of the match m."""
    of_digits = f"""case
        when m rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {_ssn(key)}
        when m rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then {_ip(key)}
        when m rlike '^([0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}|[0-9]{{2}}([/.])[0-9]{{2}}[/.][0-9]{{4}})$' then {_date(key)}
        when m rlike '^([0-9]{{13,19}}|[0-9]{{4}}([ -][0-9]{{4}}){{3}})$' then {_card(key)}
        else {_phone(key)} end"""
    return f"case when contains(m, '@') then {_email(key)} else transform(array(regexp_replace(m, '[^0-9]', '')), n -> {of_digits})[0] end"


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with the personal data in column `text` replaced; count: a name for the number of replacements.

    Null stays null; empty texts and texts without personal data stay as they are, and so do all other columns.
    Equal rows give equal rows. key is a secret: who has it can reverse every pseudonym. Dates before 1900 or after
    2099-11-12 stay.
    """
    column = f"`{text}`"
    pieces = f"split({column}, {_text(ANY)}, -1)"
    again = f"array_join(zip_with({pieces}, fs, (p, x) -> concat(p, coalesce(x, ''))), '')"
    changed = "size(filter(arrays_zip(ms, fs), z -> z.ms <> z.fs))"
    done = f"transform(array(transform(ms, m -> {_pseudonym(key)})), fs -> named_struct('text', {again}, 'n', {changed}))[0]"
    found = f"transform(array(regexp_extract_all({column}, {_text(ANY)}, 0)), ms -> if(size(ms) = 0, named_struct('text', {column}, 'n', 0), {done}))[0]"
    made = F.expr(f"case when {column} rlike '[0-9@]' then {found} else named_struct('text', {column}, 'n', 0) end")
    hidden = "_pseudonymised"
    while hidden in docs.columns:
        hidden += "_"
    out = docs.withColumn(hidden, made).withColumn(text, F.col(f"{hidden}.text"))
    if count:
        out = out.withColumn(count, F.col(f"{hidden}.n"))
    return out.drop(hidden)


def op3_pii(spark: SparkSession, sf_dir: str, key: str = "an example key; give your own") -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key, count="n_replaced")
