"""Secrets: base spans by the definition, and the chains on planted and held-out values."""

import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from tests.llm.tables import awkward, empty, tuples
from tidings.llm import secrets

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def _base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def _row(doc_id, text):
    spans = _base(text or "")
    listed = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    return (doc_id, *(sum(k == kind for _, k, _ in spans) for kind in range(3)), hashlib.sha256(listed.encode()).hexdigest())


HEX = "0123456789abcdef" * 3
TEXTS = [
    'password = "hunter2hunter2"', "PassWD:'short' token:abc", "token: token: abcdefgh", "api_key=apikey=apikey=12345678", "API-KEY: nothing here",
    f"x {HEX} y", f"secret={HEX}", f"😀 é {HEX}😀 token=\t", "AKIA" + "A1" * 8, "AKIA" + "Z" * 15, "zAKIAKIA" + "9" * 16, "AKIA" * 6 + "a",
    "ſecret=abcdefgh toKen=abcdefgh", "token" * 50 + "=" * 50 + "abcdef", "secret = 'a.b-c/d+e_f='", "", None, "a" * 23, "a" * 24, "password" + " " * 500 + ":x12345",
    "password\n=abcdefg", f"{HEX}\n{HEX} {HEX}", "token=abcdef;token=abcdef,TOKEN='abcdef'",
]


def _scan(spark, texts, **how):
    return secrets.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), **how)


def test_base_spans(spark):
    found = _scan(spark, TEXTS).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert tuples(found) == sorted((_row(i, t) for i, t in enumerate(TEXTS)), key=repr)


def test_base_spans_of_random_texts(spark):
    r = random.Random(5)
    parts = ["token", "Secret", "api", "_", "key", "passwd", "=", ":", " ", "'", '"', "AKIA", "A1B2C3D4E5F6G7H8", "abc", "0123456789abcdef", "é", "\n", ".", "-"]
    texts = ["".join(r.choices(parts, k=r.randrange(60))) for _ in range(1500)]
    found = _scan(spark, texts).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert tuples(found) == sorted((_row(i, t) for i, t in enumerate(texts)), key=repr)


def _random_value(r, letters, size):
    return "".join(r.choices(letters, k=size))


def _identifier(r):
    words = "user account order line customer address total result parse load config index value update file name response handler service list".split()
    join = r.choice(["_", "-", "/", ""])
    return join.join(w.capitalize() if not join else w for w in r.choices(words, k=r.randrange(4, 7)))


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(9)
    mixed = string.ascii_letters + string.digits
    rows = [(_random_value(r, r.choice([mixed, mixed + "+/", "0123456789abcdef"]), r.randrange(16, 48)), True) for _ in range(2000)]
    rows += [(_identifier(r), False) for _ in range(2000)]
    return spark.createDataFrame(rows, "value string, secret boolean")


def test_held_out_values_are_told_apart(spark, labelled):
    held_out = F.crc32("value") % 4 == 0
    model = secrets.train(labelled.where(~held_out))
    judged = labelled.where(held_out).select("secret", (secrets.ratio(F.col("value"), model) >= secrets.RATIO).alias("found"))
    counts = {(r["secret"], r["found"]): r["count"] for r in judged.groupBy("secret", "found").count().collect()}
    assert counts[True, True] >= 0.95 * (counts[True, True] + counts.get((True, False), 0))
    assert counts.get((False, True), 0) <= 0.01 * counts[False, False]


def test_chains_add_spans_and_leave_base_spans(spark, labelled):
    r = random.Random(2)
    texts = []
    for i in range(60):
        planted = _random_value(r, string.ascii_letters + string.digits, 32)
        texts.append(f"é the {_identifier(r)} needs {planted}. And token={HEX} {_identifier(r)} 4111111111111111")
    found = _scan(spark, texts, labelled=labelled)
    for row in found.collect():
        text = texts[row["doc_id"]]
        planted = re.search("needs ([A-Za-z0-9]+)", text)
        base = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in _base(text)]
        assert row["spans"] == ",".join([f"markov:{planted.start(1)}:{planted.end(1)}", *base]), text
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and row["n_markov"] == 1


def test_own_samples_find_random_strings_of_other_alphabets(spark):
    """Only hex values are assigned; one run in 300 is a string of letters and digits without any word.
    Such strings are among the ordinary samples, so a few may be missed."""
    r = random.Random(4)
    texts = [f"token = {_random_value(r, '0123456789abcdef', 40)}" for _ in range(50)]
    texts += [f"{_identifier(r)} and {_identifier(r)}" for _ in range(3000)]
    texts += [_random_value(r, string.ascii_letters + string.digits, 40) for _ in range(20)]
    rows = {row["doc_id"]: row["n_markov"] for row in _scan(spark, texts).collect()}
    assert sum(rows[i] for i in range(3050)) == 0
    assert sum(rows[i] for i in range(3050, 3070)) >= 18


def test_very_long_runs_and_awkward_tables(spark):
    texts = ["A1" * 500_000, "password=" + "x1" * 500_000, "token=abcdef " * 20_000, ("a" + "." * 40) * 5_000]
    found = {r["doc_id"]: r for r in _scan(spark, texts).collect()}
    assert [found[i]["n_assign"] for i in range(4)] == [0, 1, 20_000, 0]
    odd = awkward(spark)
    assert tuples(secrets.scan(odd).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")) == sorted(
        (_row(r["doc_id"], r["text"]) for r in odd.collect()), key=repr)
    assert secrets.scan(empty(spark)).count() == 0


def test_no_python_worker_runs(spark):
    documents = awkward(spark)
    plan = secrets.located(secrets.found(documents))._jdf.queryExecution().executedPlan().toString()
    plan += secrets.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
