"""Quality rules, license scans, sharding, language-model scores and vector search against plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plansmith.llm import lm_scoring
from plansmith.llm.license_scan import TEMPLATES, align, longest_increasing, make_templates, scan_licenses, scan_text
from plansmith.llm.quality_rules import fitted_lows, quality_rules, script_of
from plansmith.llm.sharding import FeistelPermutation, shard_rows, write_shards
from plansmith.llm.tokens import vocabulary_path
from plansmith.llm.vector_files import ApproximationFile, exact_top_k

from .data import documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_rules(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_quality_rules(spark):
    rows = [*documents(), (100, "same words again and again here now ok " * 9, "en", "s", 1, "e"), (101, "a # b *** <tag> " * 3 + "word " * 3 + " ".join(f"w{i}" for i in range(200)), "en", "s", 1, "e"), (102, "是的 " * 40, "zz", "s", 1, "e")]
    out = quality_rules(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(map(repr, ((r["doc_id"], *[r[n] for n in names]) for r in out))) == sorted(map(repr, ((r[0], *plain_rules(r[1])) for r in rows)))
    by = {r["doc_id"]: r for r in out}
    assert not any(r["kept"] for r in out if r["base_failed"])
    assert by[8]["kept"] and not by[100]["kept"] and by[102]["band"] == "cjk"
    assert quality_rules(frame(spark, [])).count() == 0
    assert quality_rules(frame(spark).drop("lang"), keep_text=True).where("text IS NOT NULL").count() == sum(r[1] is not None for r in documents())
    with pytest.raises(ValueError):
        quality_rules(frame(spark).withColumnRenamed("extra", "kept"))


def test_fertility_against_the_libraries(spark):
    """Characters per token of both vocabularies, byte share and entropy from encoding words one by one."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    pieces, other = SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model")), Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    other.encode_special_tokens = True  # their strings are plain text here
    got = {r["doc_id"]: r for r in quality_rules(frame(spark)).where("doc_id IS NOT NULL").collect()}
    for i, text, *_ in documents():
        if i is None:
            continue
        words = WORD.findall(text or "")
        ids = [x for w in words for x in pieces.encode(w)]
        n_other = sum(len(other.encode(w, add_special_tokens=False).ids) for w in words)
        chars = sum(map(len, words))
        r = got[i]
        assert r["n_pieces"] == len(ids)
        if not ids:
            assert (r["chars_per_token"], r["chars_per_other"], r["byte_share"], r["token_entropy"]) == (0, 0, 0, 0)
            continue
        shares = [n / len(ids) for n in Counter(ids).values()]
        bits = -sum(p * math.log2(p) for p in shares)
        assert math.isclose(r["chars_per_token"], chars / len(ids)) and math.isclose(r["chars_per_other"], chars / n_other)
        assert math.isclose(r["byte_share"], sum(map(pieces.is_byte, ids)) / len(ids))
        assert math.isclose(r["token_entropy"], bits / math.log2(min(len(ids), 4096)) if len(ids) > 1 else 0.0, abs_tol=1e-12)


def test_words_learned_together_are_as_alone():
    """Many words in one call of each library, with odd ones among them."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from plansmith.llm import quality_rules as q

    pieces, other = SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model")), Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    rng = np.random.default_rng(5)
    chars = [*"abcXYZ'st.,!-|1290", "é", "ß", "日", "\u00a0", "\u3000", "\x01", "\x00", "🎉", "▁"]
    words = ["'sabc", "don't", "'", "\x01", "a\x01b", "\u00a0\u00a0", "x\u3000\u3000", "<|endoftext|>".replace("|", "!")]
    words += ["".join(rng.choice(chars, rng.integers(1, 12))) for _ in range(3000)]
    raw = [w.encode() for w in dict.fromkeys(words) if w]
    f = q.Fertility(vocabulary_path("piece_bpe_32k.model"), vocabulary_path("byte_bpe_50k.tiktoken"))
    f.n_other = 0
    f.ids(raw)
    for w in raw:
        assert np.frombuffer(f.words[w], f.kind).tolist() == pieces.encode(w.decode()), w
        assert f.lengths[w] == len(other.encode(w.decode(), add_special_tokens=False).ids), w


def test_fertility_with_a_full_cache(monkeypatch):
    """Emptying the cache of words changes no measure."""
    from plansmith.llm import quality_rules as q

    paths = vocabulary_path("piece_bpe_32k.model"), vocabulary_path("byte_bpe_50k.tiktoken")
    texts = [[w.encode() for w in f"again and again word{i} other{i} and some{i}".split()] for i in range(20)]
    whole = q.Fertility(*paths)
    want = [whole.measure(t, 40) for t in texts]
    monkeypatch.setattr(q, "MAX_CACHED", 9)
    small = q.Fertility(*paths)
    assert [small.measure(t, 40) for t in texts] == want and len(small.words) <= 9


def test_verdict_rests_on_the_text_alone(spark):
    """Noise goes and prose stays in every language of the table, whether a text stands alone or among many."""
    rng = np.random.default_rng(6)
    common = "the of and to in that for with this from have which their about there would people could other after first these water where through".split()
    noise = lambda: " ".join("".join(rng.choice(list("bcdfghjkmpqvwxz"), 9)) for _ in range(60))
    rows = [(i, " ".join(rng.choice(common, 60)), "en", "s", 1, "e") for i in range(240)]
    rows += [(1000 + i, noise(), ["en", "de", "fr", "es"][i % 4], "s", 1, "e") for i in range(8)]
    prose = {"de": "Die Bibliothek der Stadt öffnet jeden Morgen um acht Uhr und schließt erst spät am Abend, wenn die letzten Leser gegangen sind und das Licht im Saal ausgeht.", "fr": "La bibliothèque de la ville ouvre tous les matins à huit heures et ferme tard le soir, quand les derniers lecteurs sont partis et que la lumière s'éteint dans la salle.", "es": "La biblioteca de la ciudad abre todas las mañanas a las ocho y cierra tarde por la noche, cuando se han ido los últimos lectores y se apaga la luz de la sala."}
    rows += [(2000 + i, t, lang, "s", 1, "e") for i, (lang, t) in enumerate(prose.items())]
    out = {r["doc_id"]: r for r in quality_rules(frame(spark, rows)).collect()}
    assert all(not r["base_failed"] for r in out.values())
    assert all(out[i]["kept"] for i in range(240)) and not any(out[1000 + i]["kept"] for i in range(8)) and all(out[2000 + i]["kept"] for i in range(3))
    for i in (0, 1000, 1001, 2000):
        (alone,) = quality_rules(frame(spark, [r for r in rows if r[0] == i])).collect()
        assert alone == out[i]


def test_fitted_lows(spark):
    rows = [("en", True, 3 + i / 100, 4.0) for i in range(101)] + [("en", False, 0.1, 0.1), ("fr", True, 2.0, 2.0)]
    got = {(r["band"], r["measure"]): round(r["lowest"], 6) for r in fitted_lows(spark.createDataFrame(rows, "band string, kept boolean, chars_per_token double, chars_per_other double")).collect()}
    assert got == {("en", "chars_per_token"): 1.5, ("en", "chars_per_other"): 3.68, ("fr", "chars_per_token"): 1.84, ("fr", "chars_per_other"): 1.84}


OTHER_SCRIPTS = {
    "greek": "Η βιβλιοθήκη της πόλης ανοίγει κάθε πρωί στις οκτώ και κλείνει αργά το βράδυ, όταν φεύγουν και οι τελευταίοι αναγνώστες. Πολλοί φοιτητές διαβάζουν εκεί για τις εξετάσεις τους.",
    "arabic": "تفتح مكتبة المدينة أبوابها كل صباح في الساعة الثامنة وتغلق في وقت متأخر من المساء عندما يغادر آخر القراء. يدرس هناك كثير من الطلاب استعدادا للامتحانات النهائية في نهاية كل عام",
    "hebrew": "ספריית העיר נפתחת בכל בוקר בשעה שמונה ונסגרת מאוחר בערב כאשר אחרוני הקוראים עוזבים את המקום. סטודנטים רבים לומדים שם לקראת הבחינות שלהם בסוף השנה וגם במשך הקיץ",
    "thai": "ห้องสมุด ของ เมือง เปิด ทุก เช้า เวลา แปด โมง และ ปิด ตอน ค่ำ เมื่อ ผู้อ่าน คน สุดท้าย กลับ บ้าน นักเรียน หลาย คน อ่าน หนังสือ ที่นั่น ก่อน สอบ ปลาย ปี",
    "hindi": "शहर का पुस्तकालय हर सुबह आठ बजे खुलता है और देर शाम को बंद होता है जब आखिरी पाठक घर चले जाते हैं। बहुत से छात्र वहाँ अपनी परीक्षाओं की तैयारी करते हैं",
    "armenian": "Քաղաքի գրադարանը բացվում է ամեն առավոտ ժամը ութին և փակվում է ուշ երեկոյան, երբ վերջին ընթերցողները տուն են գնում։ Շատ ուսանողներ այնտեղ պատրաստվում են իրենց քննություններին տարվա վերջում",
}


def test_script_of_most_letters(spark):
    rows = []
    for i, text in enumerate(OTHER_SCRIPTS.values()):
        rows += [(10 * i + k, text + tail, [None, "el"][k % 2], "s", 1, "e") for k, tail in enumerate(["", " x", " www.example.org", " Anna"])]
    out = quality_rules(frame(spark, rows)).collect()
    assert len(out) == 24 and all(r["band"] == "other" and r["kept"] for r in out)
    long = "The library of the town opens every morning at eight and closes late when all have left. "
    for text in OTHER_SCRIPTS.values():
        assert script_of(text + 4 * long) == "latin"
        assert script_of(text + 8 * "Городская библиотека открывается каждое утро. ") == "cyrillic"
        assert script_of(text + 40 * "図書館は毎朝開く。") == "cjk"
    assert script_of("Thư viện của thành phố mở cửa mỗi buổi sáng") == "latin" and script_of("ỗẫậợự ế") == "latin"
    assert script_of("αβ ab") == "latin" and script_of("αβγ ab") == "other" and script_of("… 12 —") == "other" and script_of("12") == "latin"


def test_license_alignment():
    assert longest_increasing([3, 1, 2, 9, 4, 5]) == [1, 2, 4, 5] and longest_increasing([]) == []
    assert align("a b x c".split(), ("a", "b", "c")) == [(0, 0), (1, 1), (3, 2)]
    templates = make_templates()
    vocabulary = frozenset(w for t in templates for w in t.words)
    scan = lambda t: scan_text(t, templates, vocabulary)
    for name, notices in TEMPLATES.items():
        for n in notices:
            text = f"Some words before.\n{n}\nand after it"
            (m,) = scan(text)
            assert (m["license"], m["coverage"]) == (name, 1.0) and text[m["begin"] : m["end"]] in n
    twice = scan("Released under the MIT License. Released under the MIT License.")
    assert [m["license"] for m in twice] == ["MIT", "MIT"]
    (m,) = scan("İ Licensed under the Apache Licence, Version 2.0")
    assert m["license"] == "Apache-2.0" and m["coverage"] == 7 / 8
    assert scan(None) == scan("") == scan("the public is licensed to work under version of this") == []


def longest_common(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] + 1 if x == y else max(last[j], row[-1]))
        last = row
    return last[-1]


def test_alignment_against_the_longest_common_subsequence():
    rng = np.random.default_rng(8)
    for trial in range(60):
        template = [f"w{x}" for x in rng.integers(0, [8, 40, 200][trial % 3], rng.integers(1, 60))]
        kept = [w for w in template if rng.random() < 0.8]
        text = [w for x in kept for w in ([x] if rng.random() < 0.7 else [x, f"other{rng.integers(0, 9)}"])]
        pairs = align(text, tuple(template))
        assert all(text[x] == template[y] for x, y in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))  # noqa: B905
        best = longest_common(text, template)
        assert len(pairs) <= best
        if trial % 3 == 2:  # nearly all words are unique: the anchors are the longest common subsequence
            assert len(pairs) >= 0.9 * best
        whole = [w for x in dict.fromkeys(template) for w in (x, "between")]
        assert len(align(whole, tuple(dict.fromkeys(template)))) == len(set(template))


def test_license_names_must_match():
    templates = make_templates()
    vocabulary = frozenset(w for t in templates for w in t.words)
    found = lambda t: [m["license"] for m in scan_text(t, templates, vocabulary)]
    assert found("Released under the ISC License.") == ["ISC"] and found("This project is licensed under the Zlib License.") == ["Zlib"]
    assert found("Released under the Foo License.") == found("This project is licensed under the Foo License.") == []
    assert found("Licensed under the BSD 2-Clause License.") == ["BSD-2-Clause"] and found("Licensed under CC BY-ND 4.0.") == []
    assert found("This work is licensed under the GNU Lesser General Public License, version 2.1.") == ["LGPL-2.1"]
    assert found("This work is licensed under the GNU Lesser General Public License, version 3.") == ["LGPL-3.0"]
    assert found("This project is licensed under the Foo License. This project is licensed under the MIT License.") == ["MIT"]
    two = TEMPLATES["BSD-2-Clause"][-1]
    at = two.index("THIS SOFTWARE")
    clause = "3. All advertising materials mentioning features of this software must display an acknowledgement. "
    assert found(two) == ["BSD-2-Clause"] == found(two[:at] + "* " + two[at:]) and found(two[:at] + clause + two[at:]) == ["BSD"]
    for third in ("Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission. "):
        assert found(two[:at] + "3. " + third + two[at:]) == ["BSD-3-Clause"]
    whole = TEMPLATES["MIT"][-1]
    (m,) = scan_text("Copyright 2020 A B\n" + whole + " End.", templates, vocabulary)
    assert m["license"] == "MIT" and m["coverage"] == 1.0 and m["end"] - m["begin"] > 900


def test_license_rows(spark):
    rows = [*documents(), (200, "Intro text\nReleased under the MIT License.\nmore", "en", "s", 1, "e")]
    out = {r["doc_id"]: r["matches"] for r in scan_licenses(frame(spark, rows)).collect()}
    assert [m["license"] for m in out[200]] == ["MIT"] and all(not m for k, m in out.items() if k != 200)
    assert scan_licenses(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 24, 100, 1000, 4097])
def test_feistel(n):
    p = FeistelPermutation(n, seed=7)
    at = p.position(np.arange(n))
    assert sorted(at.tolist()) == list(range(n)) and (p.row(at) == np.arange(n)).all()
    shard, slot = p.place(np.arange(n), 24)
    assert max(Counter(shard.tolist()).values()) - min([Counter(shard.tolist())[s] for s in range(24)]) <= 1
    assert p.row_at(int(shard[n // 2]), int(slot[n // 2]), 24) == n // 2
    if n > 1000:
        assert (FeistelPermutation(n, seed=8).position(np.arange(n)) != at).mean() > 0.9


def test_sharding(spark):
    docs = frame(spark)
    out = shard_rows(docs, ["doc_id", "text"], shards=5)
    rows = out.collect()
    assert len(rows) == len(documents()) and sorted(r["row_number"] for r in rows) == list(range(len(rows)))
    ordered = [r["doc_id"] for r in sorted(rows, key=lambda r: r["row_number"])]
    assert ordered[0] is None and ordered[1:] == sorted(ordered[1:])
    slots = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(5)}
    assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = {(r["row_number"], r["shard"], r["slot"]) for r in shard_rows(docs.repartition(5), ["doc_id", "text"], shards=5).collect()}
    assert again == {(r["row_number"], r["shard"], r["slot"]) for r in rows}
    assert spark.read.parquet(write_shards(out)).count() == len(rows)
    assert shard_rows(frame(spark, []), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        shard_rows(docs.withColumnRenamed("extra", "slot"), ["doc_id"])


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_losses(rows, wanted):
    """Losses of each row under both models, from counts of the words themselves, and a check that probabilities sum to one."""
    lists = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    pairs = [list(zip([None, *w], w)) for w in lists]  # noqa: B905
    words = {x for w in lists for x in w}
    v = len(words) + 1
    count = lambda side, of: Counter(x for (i, _), xs in zip(rows, of, strict=True) if (i in wanted) == side for x in xs)
    uni, bi = {k: count(k, lists) for k in (True, False)}, {k: count(k, pairs) for k in (True, False)}
    before = {k: count(k, [[x for x, _ in p] for p in pairs]) for k in (True, False)}
    total = {k: sum(uni[k].values()) for k in uni}
    out = []
    for n, ((i, _), w, p) in enumerate(zip(rows, lists, pairs, strict=True)):
        losses = []
        for side in (True, False):
            own = (i in wanted) == side
            ow, op, ob = (Counter(w), Counter(p), Counter(x for x, _ in p)) if own else (Counter(), Counter(), Counter())
            first = lambda y: (uni[side][y] - ow[y] + lm_scoring.ALPHA) / (total[side] - own * len(w) + lm_scoring.ALPHA * v)  # noqa: B023, E731
            prob = lambda x, y: (bi[side][x, y] - op[x, y] + lm_scoring.MU * first(y)) / (before[side][x] - ob[x] + lm_scoring.MU)  # noqa: B023, E731
            if n < 3:
                for x in [None, *list(words)[:3]]:
                    assert math.isclose(sum(prob(x, y) for y in [*words, "never seen"]), 1.0, rel_tol=1e-9)
            losses.append(-sum(math.log(prob(x, y)) for x, y in p) / len(w) if w else None)
        out.append((i, len(w), *losses))
    return out


def same_losses(got, want):
    assert len(got) == len(want)
    order = lambda x: (x[0] is None, x[0], x[1], x[2] or 0.0)
    for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert g[:2] == w[:2]
        assert g[2:] == (None, None) if w[2] is None else all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(g[2:], w[2:], strict=True))


@pytest.mark.parametrize("small", [False, True])
def test_cross_entropy_difference(spark, monkeypatch, small):
    if small:  # many batches and ranges
        monkeypatch.setattr(lm_scoring, "BATCH_BYTES", 700)
        monkeypatch.setattr(lm_scoring, "RANGE_ENTRIES", 500)
    targets = spark.createDataFrame([(8,), (9,), (9,), (None,), (12,), (6,)], "doc_id long")
    rows = documents() + [(900 + i, "The same text stands twice, of words that no other has: qqa qqb qqc", "en", "s", 1, "e") for i in range(2)]
    out = lm_scoring.cross_entropy_difference(frame(spark, rows), targets).collect()
    want = brute_losses([r[:2] for r in rows], {8, 9, 12, 6})
    same_losses([(r["doc_id"], r["n_words"], r["target_loss"], r["background_loss"]) for r in out], want)
    assert all(r["is_target"] == (r["doc_id"] in {8, 9, 12, 6}) for r in out)
    assert all(r["score"] is None if not r["n_words"] else math.isclose(r["score"], r["target_loss"] - r["background_loss"], abs_tol=1e-9) for r in out)
    assert lm_scoring.cross_entropy_difference(frame(spark, []), targets).count() == 0
    assert lm_scoring.cross_entropy_difference(frame(spark), targets.limit(0)).where("is_target").count() == 0


def test_cross_entropy_counts_exactly(spark):
    """So many words and pairs that any table of a fixed size would mix some."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 4000) % 3000) for _ in range(12)] + [" ".join(f"u{i}" for i in range(270_000)), "w1 w1 w2", "W1"]
    rows = list(enumerate(texts))
    wanted = {0, 3, 13}
    out = lm_scoring.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(i,) for i in wanted], "doc_id long")).collect()
    same_losses([(r["doc_id"], r["n_words"], r["target_loss"], r["background_loss"]) for r in out], brute_losses(rows, wanted))


def brute_top(rows, k):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, v) for i, v in good if not v or max(map(abs, v)) ** 2 * len(v) < 2**63]
    out = set()
    for q, a in good:
        if q % 10:
            continue
        best = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b)))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def test_exact_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6) * 0.3]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(60)]  # a common vector: ties
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, rows[1][1]), (410, [1.0, 2.0]), (420, [3.0, 1.0]), (430, []), (440, [2e9] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    got = {(r["query_id"], r["rank"], r["id"], r["score"]) for r in exact_top_k(df, F.col("vec_id") % 10 == 0, k=7).collect()}
    assert got == brute_top(rows, 7)
    assert exact_top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_floors_and_wide_components(spark):
    """Many vectors in many groups, floors from one group; components of eight bytes; vectors whose products may pass 63 bits take no part."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(2000)]
    rows += [(5000 + i, [1.1e6 + 1e4 * i, 1.0, -2.5e5, 0.0]) for i in range(12)] + [(6000, [3e6] * 4), (6010, [9e15, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {(r["query_id"], r["rank"], r["id"], r["score"]) for r in exact_top_k(df, F.col("vec_id") % 10 == 0, k=10).collect()}
    assert got == brute_top(rows, 10) and not any(6010 in (q, i) for q, _, i, _ in got) and any(i == 5001 for _, _, i, _ in got)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    v, q = rng.integers(-900, 900, (200, 16)), rng.integers(-900, 900, (5, 16))
    for bits in (1, 3, 6, 12):
        f = ApproximationFile(np.arange(200), v, bits)
        assert (f.bounds(q) >= (q @ v.T)).all()


def test_license_query_has_all_matches(spark, tmp_path):
    from plansmith.llm.queries import op9_license_scan

    text = "Released under the MIT License. Then other words here. Licensed under the Apache License, Version 2.0."
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (r,) = op9_license_scan(spark, str(tmp_path)).collect()
    assert [m["license"] for m in r["matches"]] == ["MIT", "Apache-2.0"] and text[r["matches"][1]["begin"] :].startswith("Licensed under the Apache")
