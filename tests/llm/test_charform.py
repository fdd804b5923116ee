import random
import time
import unicodedata

import pyarrow as pa
from cadenza.llm import charform
from cadenza.llm.charform import normal_form, tables
from cadenza.llm.codepoints import decode, encode, utf8


def one(*texts):
    out, changed = normal_form(pa.array(texts, pa.string()))
    return out.to_pylist(), changed.tolist()


def test_cases():
    texts = ["Frοzеn Café", "Ｆｊöｒｄ", "Café", "a​b", "x y", "fіrерlаϲe", "Лaнвелпот", "ﬁn", "ｶﾞ", "a\tb", "Mɑrble's", "Fakasmun'ѕ"]
    want = ["Frozen Café", "Fjörd", "Café", "ab", "x y", "fireplace", "Ланвелпот", "fin", "ガ", "a b", "Marble's", "Fakasmun's"]
    assert one(*texts) == (want, [True] * len(want))


def test_in_order():
    texts = ["Ланвелпот", "Сосо", "Café", "ガギ", "plain", "", None, "  ", "각"]
    assert one(*texts) == (texts, [False] * len(texts))


def test_agrees_with_nfkc(monkeypatch):
    t = tables()
    monkeypatch.setattr(charform, "_fold", lambda t, out, offs: out)
    pool = [c for c in range(0x21, 0x3000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Cc", "Zs", "Zl", "Zp") and not t.unseen[c] and " " not in unicodedata.normalize("NFKD", chr(c))]
    pool += [*range(0xAC00, 0xAC40), *[0x300, 0x301, 0x323, 0x327] * 50]
    rng = random.Random(1)
    texts = ["".join(chr(rng.choice(pool)) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    points, offs = decode(*utf8(pa.array(texts)))
    got = encode(*charform.normal_points(points.copy(), offs)).to_pylist()
    assert got == [unicodedata.normalize("NFKC", "".join(c for c in unicodedata.normalize("NFKD", x) if not t.unseen[ord(c)])) for x in texts]


def test_idempotent():
    got, _ = one("Ｓｅñａｌ‍", "Ρіrmassun  ", "x　y")
    assert one(*got) == (got, [False] * 3)


def test_very_many_marks():
    text = "e" + "\u0301\u0323" * 30_000 + " a\u0300b"
    start = time.perf_counter()
    form, _ = normal_form(pa.array([text, "x"]))
    assert form.to_pylist() == [unicodedata.normalize("NFC", text), "x"]
    assert time.perf_counter() - start < 20
