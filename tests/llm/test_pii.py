import datetime
import hashlib

from folio.llm import pii
from tests.llm.rows import HARD, docs

KEY = "k'\\1"


def feistel(values, radices, tweak):
    h = (len(values) + 1) // 2
    a, b = values[:h], values[h:]
    for r in range(1, pii.ROUNDS + 1):
        half, other, rad = (a, b, radices[:h]) if r % 2 else (b, a, radices[h:])
        seen = ",".join(map(str, other))
        new = [(x + int(hashlib.sha256(f"{KEY}|{tweak}|{r}|{i}|{seen}".encode()).hexdigest()[:12], 16)) % m for i, (x, m) in enumerate(zip(half, rad))]
        a, b = (new, b) if r % 2 else (a, new)
    return a + b


def luhn(s):
    return sum((2 * int(c) - 9 * (c > "4")) if i % 2 else int(c) for i, c in enumerate(reversed(s)))


def run(spark, texts):
    return {r.doc_id: r for r in pii.pseudonymise(docs(spark, texts), KEY, count="n").collect()}


def test_like_a_plain_feistel(spark):
    texts = ["Pay 4539578763621486, ok", "ip 10.0.255.7.", "call +1 (743) 555-3824!", "or 743-555-3824", "ssn 123-45-6789", "on 2013-11-12.", "mail Ab.9_c@Mail5.example.com."]
    got = [r.text for _, r in sorted(run(spark, texts).items())]
    body = "".join(map(str, feistel([int(c) for c in "53957876362148"], [10] * 14, "card")))
    check = next(d for d in "0123456789" if luhn("4" + body + d) % 10 == 0)
    assert got[0] == f"Pay 4{body}{check}, ok"
    assert got[1] == "ip " + ".".join(map(str, feistel([10, 0, 255, 7], [256] * 4, "ip"))) + "."
    p = "".join(map(str, feistel([int(c) for c in "7435553824"], [10] * 10, "phone")))
    assert got[2] == f"call +1 ({p[:3]}) {p[3:6]}-{p[6:]}!" and got[3] == f"or {p[:3]}-{p[3:6]}-{p[6:]}"
    a, g, s = feistel([122, 44, 6788], [898, 99, 9999], "ssn")
    assert got[4] == f"ssn {a + 1 + (a >= 665):03}-{g + 1:02}-{s + 1:04}"
    day = (datetime.date(2013, 11, 12) - datetime.date(1900, 1, 1)).days
    x, y = feistel([day // 292, day % 292], [250, 292], "date")
    assert got[5] == f"on {datetime.date(1900, 1, 1) + datetime.timedelta(x * 292 + y)}."
    local = "ab.9_c@mail5.example"
    v = feistel([ord(c) - 97 if c.isalpha() else int(c) if c.isdigit() else 0 for c in local], [26 if c.isalpha() else 10 if c.isdigit() else 1 for c in local], "email")
    want = "".join(chr((97 if c.islower() else 65) + x) if c.isalpha() else str(x) if c.isdigit() else c for c, x in zip("Ab.9_c@Mail5.example", v))
    assert got[6] == f"mail {want}.com."


def test_what_does_not_validate_stays(spark):
    stay = ["4539578763621487", "1.2.3.400", "000-12-3456", "2013-13-45", "v2.0.1", "a@b", "1776-07-04", "x" * 3000 + "@", "12345", "@" * 50, 'token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"', *HARD]
    got = run(spark, stay)
    assert [got[i].text for i in range(1, len(stay) + 1)] == stay
    assert all(r.n == 0 for r in got.values())


def test_linked_between_documents_and_distinct(spark):
    ips = [f"10.0.{i}.{j}" for i in range(8) for j in range(25)]
    got = run(spark, [*ips, "10.0.3.4 and 10.0.3.4", "2013/11/12 11/12/2013 12.11.2013 4539-5787-6362-1486 4539578763621486"])
    new = [got[i + 1].text for i in range(200)]
    assert len(set(new)) == 200
    a, _, b = got[201].text.partition(" and ")
    assert a == b == new[ips.index("10.0.3.4")] and got[201].n == 2
    d1, d2, d3, c1, c2 = got[202].text.split()
    y, m, d = d1.split("/")
    assert d2 == f"{m}/{d}/{y}" and d3 == f"{d}.{m}.{y}" and c1.replace("-", "") == c2
    assert run(spark, []) == {}
