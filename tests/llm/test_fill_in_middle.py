import hashlib
import random
import re

import pytest

from trackgraph.llm import fill_in_middle as fim


def brute(doc_id, text, form):
    text = text or ""
    units = re.findall(form.unit, text)
    n = len(units)
    digest = hashlib.sha256(f"{form.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in form.markers) or h[2] % 100 >= form.share:
        return n, "plain", None, None, text
    if h[3] % 100 < form.spm:
        return n, "spm", prefix, middle, f"{form.suffix}{suffix}{form.prefix}{prefix}{form.middle}{middle}"
    return n, "psm", prefix, middle, f"{form.prefix}{prefix}{form.suffix}{suffix}{form.middle}{middle}"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(3)
    marks = ["\x01", "\x02", "\x021", "\x022", "<", ">", "<P", "<S", "M>", "$1", "\\", "ä", "😀", "\r", "\n", "\n\n", "a b", "|"]
    texts = [None, "", "\n", "\n\n\n", "one", "one\n", "has <P> in it\nx", "<S>", "<M", "\x01\n\x01", "\x02\n\x022"]
    texts += ["".join(rnd.choice(marks) for _ in range(rnd.randint(1, 60))) for _ in range(150)]
    texts += ["word " * 40_000, "line\n" * 40_000 + "end"]
    rows = [(k, t, "clash", 5) for k, t in enumerate(texts)] + [(None, "x\ny\nz\n", "clash", 5), (3, "again\nand\nagain", "clash", 5), (3, "again\nand\nagain", "clash", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, n long").repartition(4).cache()


@pytest.mark.parametrize("form", [fim.Form(), fim.Form(unit=r"\S+\s*|\s+", seed=11, share=60, spm=20), fim.Form(prefix="[[a", suffix="[[bb", middle="[[c")])
def test_outputs_and_restored_texts(docs, form):
    got = fim.restored(fim.rearranged(docs, form), form).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n, r.form, r.prefix, r.middle, r.output) == brute(r.doc_id, r.text, form)
        assert r.restored == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_digests(docs):
    for r in fim.digests(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        n, form, prefix, middle, output = brute(r.doc_id, r.text, fim.Form())
        size = lambda x: None if x is None else len(x)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, size(prefix), size(middle)) or r.doc_id == 3
        if r.doc_id != 3:
            assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
            assert r.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_no_documents(spark):
    assert fim.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_markers_that_overlap_themselves_are_refused():
    with pytest.raises(ValueError):
        fim.Form(prefix="<P<")


def test_no_python_workers(spark):
    plan = fim.digests(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
