import hashlib
import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from juryframe.llm import secrets
from juryframe.llm.queries import op8_secret_scan

ALLOW = secrets.allow_list(secrets.ALLOWED)


def plain_base(text):
    """The patterns as they are worded, short matches dropped afterwards."""
    found = []
    pattern = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [("assign", m.start(), m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ("assign", "access", "hex")
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


pieces = st.sampled_from(["token", "Secret", "paſſword", "api_key", "APIKEY", ":", "=", " ", '"', "'", "abcdef", "0123456789abcdef01234567", "AKIA", "ABCDEFGHIJKLMNOP", "é", "😀", "\n", "-", "x"])


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=14).map("".join))
def test_base_spans(text):
    found = sorted(((k, a, b) for a, k, b in secrets.base_spans(text)), key=lambda s: (s[1], secrets.KINDS.index(s[0])))
    assert found == plain_base(text)


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdef0123", min_size=20, max_size=60), st.sampled_from([2.0, 2.5, 3.0]))
def test_windows_against_plain_entropy(string, limit):
    covered = set()
    for i in range(len(string) - 19):
        if entropy(string[i : i + 20]) > limit + 1e-9:
            covered |= set(range(i, i + 20))
    assert {i for a, b in secrets.high_windows(string, limit) for i in range(a, b)} == covered


def test_what_is_found_and_what_is_not():
    key = "kR7xQ2mZ9pLw4TbVn8Yc1Hs6"
    assert [k for _, k, _ in secrets.find_secrets(f"see {key} here", ALLOW)] == ["entropy"]
    for clean in ("theandingertionthatofandtherein", "word-after-word-after-word-after", "path/to/some/longer/place/of/things", "123e4567-e89b-12d3-a456-426614174000", "12345-67890-12345-67890", "====================A=a", "AAAAAAAAAAAAAAAAAAAAAAAAAA"):
        assert secrets.find_secrets(f"see {clean} here", ALLOW) == []
    inside = secrets.find_secrets(f"token={key}", ALLOW)
    assert [k for _, k, _ in inside] == ["assign"]


def test_redaction_hides_every_span(documents, prose):
    key = "kR7xQ2mZ9pLw4TbVn8Yc1Hs6"
    rows = [(1, f"é {key} token = abcdef123 end", "en", "a"), (2, prose(30, 1), "en", "a"), (3, None, "en", "a"), (4, "", None, None)]
    df = documents(rows)
    out = {r["doc_id"]: r for r in secrets.redact_secrets(df, chars_col="n_chars").collect()}
    assert out[1]["text"] == "é [SECRET] [SECRET] end" and out[1]["n_chars"] == len(out[1]["text"])
    assert [out[i]["text"] for i in (2, 3, 4)] == [rows[1][1], None, ""] and out[2]["n_chars"] == len(rows[1][1])


def rows_match(found, texts):
    for r in found:
        text = texts[r["doc_id"]] or ""
        base = plain_base(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        counts = Counter(k for k, _, _ in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (counts["assign"], counts["access"], counts["hex"])
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("entropy")] == [s for s in listed.split(",") if s]


def test_odd_rows(documents, odd_rows):
    found = secrets.scan_secrets(documents(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    rows_match([r for r in found if r["doc_id"] is not None], {i: t for i, t, _, _ in odd_rows})


def test_empty(documents):
    assert secrets.scan_secrets(documents([])).count() == 0 and secrets.redact_secrets(documents([])).count() == 0


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op8_secret_scan(spark, sf_dir).collect()
    assert len(found) == len(texts)
    rows_match(found, texts)


def test_hex_key_beside_other_characters():
    rng = random.Random(1)
    alone = beside = 0
    for _ in range(200):
        key = "".join(rng.choice("0123456789ABCDEF") for _ in range(40))
        own = {i for a, _, b in secrets.find_secrets(f" {key} ", ALLOW) for i in range(a - 1, b - 1)}
        alone += bool(own)
        for before in ("KEY=", "/", "sha-", "x_", "+"):
            found = {i for a, _, b in secrets.find_secrets(f" {before}{key} ", ALLOW) for i in range(a - 1 - len(before), b - 1 - len(before))}
            assert own <= found
            beside += bool(found)
    assert alone == 200 and beside == 1000


def test_many_spans_take_no_longer_than_their_number():
    import time

    from juryframe.llm import secrets

    allow, rng = secrets.allow_list(secrets.ALLOWED), random.Random(4)
    key = lambda: "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(40))
    lines = [f"token = {key()}" if i % 2 else f"k{i} {key()} 0123456789abcdef0123456789abcdef" for i in range(12_000)]
    brute = lambda text: sorted((b := secrets.base_spans(text)) + [s for s in secrets.entropy_spans(text, allow) if not any(x[0] <= s[0] and s[2] <= x[2] for x in b)], key=lambda s: (s[0], secrets.KINDS.index(s[1]), s[2]))
    some = "\n".join(lines[:300])
    assert secrets.find_secrets(some, allow) == brute(some)
    began = time.process_time()
    whole = secrets.find_secrets("\n".join(lines), allow)
    alone = sum(len(secrets.find_secrets(line, allow)) for line in lines)
    assert len(whole) == alone and time.process_time() - began < 30
