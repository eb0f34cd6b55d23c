import hashlib
import itertools
import random
import re
import time
import tracemalloc

import pytest

from strandloom.llm import secret_scan as S
from strandloom.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def names(text):
    return [x[1] for x in S.findings(text)]


@pytest.mark.parametrize("text", [
    f'token = "{HEX}"', f"api_key: '{HEX}'", f'{{"secret": "{HEX}", "n": 3}}', f"export DB_PASSWORD=s3cr3t-Pa55", f"access_key := `{HEX}`",
    f"'client_secret' => '{HEX}'", f'password: str = "hunter2hunter"', f'cfg["apiKey"] = "{HEX}"', f'String privateKey = """{HEX}""";', f"x, y the token = \"{HEX}\" of it",
])
def test_assignments(text):
    assert len(S.findings(text)) == 1


@pytest.mark.parametrize("text", [
    f'checksum = "{HEX}"', 'password = os.environ["PW"]', "password = getpass()", 'token_count = "123456789012"', 'password = "changeme"', f'if token == "{HEX}":',
    "The key: a long story about nothing", "token = <your token here>", 'secret = ""', "https://token:8080/x", "a = b = c",
])
def test_others(text):
    assert S.findings(text) == []


PEM = f"-----BEGIN RSA PRIVATE KEY-----\\n{HEX}\\n{HEX[::-1]}\\n-----END RSA PRIVATE KEY-----"


@pytest.mark.parametrize("text", [
    f'private_key = "{PEM}"', f'"Authorization": "Bearer {HEX}"', f"Authorization: Bearer {HEX}", f"authorization: Basic {HEX}", f'token = (\n    "{HEX[:20]}"\n    "{HEX[20:]}"\n)', f'token = ("{HEX}")',
    f'token =\n    "{HEX}"', f'token:\n  "{HEX}"\nn: 3', "a:\n  private_key: |\n    " + PEM.replace("\\n", "\n    ") + "\n  n: 3",
])
def test_schemes_blocks_and_later_lines(text):
    assert len(S.findings(text)) == 1


@pytest.mark.parametrize("text", ["Authorization: Bearer of the news", f'secret:\n  "{HEX}": 3', "secret: |\n  a long story about nothing\nn: 3"])
def test_others_on_later_lines(text):
    assert S.findings(text) == []


def test_constants_are_propagated():
    a, b = HEX[:20], HEX[20:]
    (whole,) = S.findings(f'token = "{HEX}"')
    for text in (f'A = "{a}"\nB = A + "{b}"\ntoken = B', f'PRE="{a}"\ntoken="${{PRE}}{b}"', f'token = "{a}" \\\n  "{b}"', f'A = "{a}"\ntoken = A + \'{b}\''):
        got = S.findings(text)
        assert [x[1:] for x in got] == [whole[1:]]
    # A name assigned anew from something unknown is no longer constant.
    assert names(f'A = "{HEX}"\nA = read()\ntoken = A') == []


def test_added_parts():
    a, b = HEX[:8], HEX[8:]
    (whole,) = S.findings(f'token = "{HEX}"')
    got = S.findings(f'token = "{a}"\ntoken += "{b}"')
    assert got[-1][1:] == whole[1:]
    # Added to something unknown, a literal counts alone, and the name isn't constant.
    assert names(f'token = read()\ntoken += "{b}"\nsecret = token') == ["token"]


@pytest.mark.parametrize("n", [1, 70, 90, 5_000])
def test_typed_names_of_any_length(n):
    name = "t" * n + "_token"
    for form in ("{}: str = '{}'", "{} : None | str = '{}'", "{}:string='{}'"):
        assert names(form.format(name, HEX)) == [name]


def test_growth_is_bounded():
    began = time.perf_counter()
    doubled = 'A="abcdefghij"\n' + "".join(f'{chr(66 + k)}="${{{chr(65 + k)}}}${{{chr(65 + k)}}}"\n' for k in range(24))
    added = 'x = "ab"\n' + "x = x + x\n" * 3_000 + "y = 'cd'\n" + "y += y\n" * 3_000
    long = f'A = "{"k9" * 200_000}"\n' + "".join(f"b{k} = A\n" for k in range(40_000))
    for text in (doubled, added, long, 'a = "' * 100_000, "a = (" * 100_000, "a: |\n" * 100_000, ("a=" + "'" * 3 + "b ") * 100_000, "a = b + " * 100_000, "x" * 10**6 + "=" * 10**6, ("a = " + '"' * 3) * 50_001, "${a" * 100_000, "".join(" " * k + "a: |\n" for k in range(1_500))):
        S.findings(text)
    assert time.perf_counter() - began < 90
    tracemalloc.start()
    for text in (doubled, added, long):
        S.findings(text)
    assert tracemalloc.get_traced_memory()[1] < 30 * 10**6
    tracemalloc.stop()
    # What is left unread is only what constants bring in.
    assert names(added + f'token = "{HEX}"\n') == ["token"]


def second_reading(text):
    """Line by line, for plain assignments of quoted and named values with + between: name and value of each."""
    known, out = {}, []
    for line in text.split("\n"):
        if not (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*(\+?=)\s*(.*?)\s*", line)):
            continue
        parts = [p.strip() for p in m[3].split("+")]
        values = [p[1:-1] if p[:1] in "'\"" else known.get(p) for p in parts]
        # What follows something unknown isn't read; where it comes first, it is a bare value as in configuration.
        value = "".join(itertools.takewhile(lambda v: v is not None, values)) if values[0] is not None else parts[0]
        if m[2] == "+=":
            if m[1] not in known:
                out.append((m[1], value))
                continue
            value = known[m[1]] + value
        known[m[1]] = value
        out.append((m[1], value))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_equals_a_second_reading(seed):
    rng = random.Random(seed)
    pool = ["a", "b", "api_key", "token", "password", "checksum", "note", "db_secret"]
    part = lambda: rng.choice([f'"{rng.randbytes(rng.randrange(1, 12)).hex()}"', f"'{rng.choice(['hello', 'x1', 'Pa55word'])}'", rng.choice(pool)])
    lines = [f"{rng.choice(pool)} {rng.choice(['=', '=', '+='])} {' + '.join(part() for _ in range(rng.choice([1, 1, 2, 3])))}" for _ in range(120)]
    text = "\n".join(lines)
    want = [(n, len(v), hashlib.sha256(v.encode()).hexdigest()[:16]) for n, v in second_reading(text) if S.score(n, v)[1] >= S.THRESHOLD]
    assert want and [(x[1], x[3], x[5]) for x in S.findings(text)] == want


def test_equals_plain_pattern_on_driver_documents(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    got = {(r.doc_id, r["at"]) for r in S.scan(docs).where("name = 'token'").collect()}
    rx = re.compile(r'token = (?="[0-9a-f]{40}")')
    want = {(r.doc_id, m.end()) for r in docs.collect() for m in rx.finditer(r.text)}
    assert want and got == want


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 1), (None, f'token="{HEX}"', "en", "a", 1), (3, "a" * 2_000_000 + f'=1 ; pwd = "{HEX}"', "en", "a", 1), (4, '="' * 100_000, "en", "a", 1), (5, f'token="{HEX}', "en", "a", 1), (5, f'token="{HEX}', "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS name", "1 AS score")
    assert sorted(str(r.doc_id) for r in S.scan(docs).collect()) == ["3", "None"]
    assert S.scan(docs.limit(0)).collect() == []
