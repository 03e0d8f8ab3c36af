"""Fill-in-the-middle against a plain version, and its exact way back."""

import hashlib

import pytest

from twinledger.llm import fill_in_middle as fim
from twinledger.llm.scratch import reachable

SCHEMA = "doc_id long, text string, FORM int, output string, _key int, lang string"
TEXTS = [None, "", "a", "é", "日本語のテキスト", "plain words here", "with <P> in it", "<S>", "ends with <M", "P> begins", "<", ">", "<P", "<<", "<<S",
         "a<b>c<S", "😀 mixed é text\n\twith  blanks ", "x" * 5000, "é😀" * 3000]


def plain(doc_id, text):
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = [int(digest[i * 8:i * 8 + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows():
    made = [(i * len(TEXTS) + k, t) for i in range(12) for k, t in enumerate(TEXTS)]
    return made + made[5:9] + [(None, "no id at all"), (None, None), (-7, "negative id é")]


def frame(spark, made):
    return reachable(spark).createDataFrame([(i, t, 1, "o", 2, "en") for i, t in made], SCHEMA).repartition(3)


@pytest.mark.parametrize("part", [1 << 22, 7, 1])
def test_forms_and_way_back(spark, monkeypatch, part):
    monkeypatch.setattr(fim, "_PART", part)  # tests run in workers only with the default; the functions themselves with each
    for doc_id, text in rows():
        raw = memoryview((text or "").encode())
        n, form, prefix, middle, table = fim.arrange(raw, "" if doc_id is None else str(doc_id), 1, 90, 20)
        output = b"".join(table.stream())
        assert (n, form, prefix, middle, output.decode()) == plain(doc_id, text)
        assert b"".join(fim.restored(memoryview(output), form).stream()) == raw
        assert table.sha256() == hashlib.sha256(output).hexdigest()


def test_frames(spark):
    made = rows()
    out = fim.restore(fim.fill_in_middle(frame(spark, made)))
    assert out.columns == ["doc_id", "text", "lang", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = sorted([(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored, r.lang) for r in out.collect()], key=repr)
    assert got == sorted([(i, t, *plain(i, t), t or "", "en") for i, t in made], key=repr)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


def test_digests(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    made = rows()
    got = sorted([tuple(r) for r in fim.digests(frame(spark, made)).collect()], key=repr)
    assert got == sorted([(i, *plain(i, t)[:4], sha(plain(i, t)[4]), sha(t or "")) for i, t in made], key=repr)


def test_long_text_and_nothing(spark):
    long = "wörter und <b> 日本 " * 400_000
    got = fim.digests(frame(spark, [(3, long)])).collect()[0]
    assert (got.n, got.form, got.prefix_chars, got.middle_chars) == plain(3, long)[:4]
    assert got.output_sha256 == hashlib.sha256(plain(3, long)[4].encode()).hexdigest()
    assert got.restored_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert fim.digests(frame(spark, [])).count() == 0
    assert fim.restore(fim.fill_in_middle(frame(spark, []))).count() == 0


def test_pieces_cut_anywhere():
    table = fim.PieceTable([memoryview(b"abcdef"), memoryview(b"XYZ")], [(0, 0, 4), (1, 0, 3), (0, 4, 6)])
    for a in range(10):
        for b in range(a, 10):
            cut = table.cut(a, b)
            assert b"".join(cut.stream()) == b"abcdXYZef" and len(cut.pieces) == 5
            assert len(b"".join(cut.arranged([0]).stream())) <= max(a, 4)
