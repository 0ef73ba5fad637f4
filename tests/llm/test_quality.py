import random

import pytest

from cairnflow.llm import quality

PROSE = (
    "The index was rebuilt after the upgrade, and the queue drained within an hour. Nobody noticed that the second "
    "worker had stopped, because its log was written to another file. We will look at it again on Tuesday."
)
GERMAN = "Die Sicherung lief in der Nacht nicht durch, weil der Speicher voll war. Wir haben sie heute früh wiederholt und geprüft."
rng = random.Random(6)
CASES = {
    "prose": [
        PROSE,
        GERMAN,
        "Ok, thanks.",
        "# Notes\n\n" + PROSE + "\n\n- amber one\n- second thing\n\n" + PROSE,
        PROSE + "\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n" + PROSE + " " + PROSE,
        "Anna: did the index come back?\nBen: it did, but the second one is still slow.\nAnna: then we wait.",
        "```\nfor x in rows:\n    push(x)\n```\n" + PROSE + " " + GERMAN,
        "\n".join(PROSE[k : k + 48] for k in range(0, len(PROSE), 48)),
    ],
    "list": [
        "Parts:\n- wheel\n- frame\n- chain\n- saddle",
        "1. wash\n2. rinse\n3. dry\n4. fold\n5. store",
        "north_tower\nold-mill 12\nharbour\nlib/core/store.py\nmarket square\nEast gate",
        "* We moved the queue because it was slow.\n* The cache stays off until the next release.\n* Ask before you delete it.",
    ],
    "table": [
        "name,size,state\nalpha,12,ok\nbeta,7,n/a\ngamma,55,fail\ndelta,3,ok",
        "| name | size |\n|---|---|\n| alpha | 12 |\n| beta | 7 |\n| gamma | 9 |",
        "name      size      state\nalpha     12        ok\nbeta      7         n/a\ngamma     9         fail",
        "name\tsize\nalpha\t12\nbeta\t7\ngamma\t9\ndelta\t1",
    ],
    "junk": [
        "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(600)),
        " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(2, 12))) for _ in range(60)),
        "\n".join(f"{16 * k:08x}  " + " ".join(f"{rng.randrange(256):02x}" for _ in range(16)) for k in range(12)),
        "".join(rng.choice("!@#$%^&*()_+{}|:<>?~\n ") for _ in range(400)),
        "click here now " * 60,
        " ".join(str(rng.randrange(10**6)) for _ in range(60)),
        GERMAN.replace("e", "Ã¼").replace("a", "Ã¤").replace("i", "Ã¶"),
    ],
}


@pytest.mark.parametrize("kind", CASES)
def test_kinds(kind):
    assert [quality.measure(t)[-1] for t in CASES[kind]] == [kind] * len(CASES[kind])


def test_counts():
    n, length, signs, punctuated, common, language, *_ = quality.measure("The cat, the dog.\nno end")
    assert (n, language) == (6, "en")
    assert length == pytest.approx(17 / 6) and signs == pytest.approx(2 / 19)
    assert punctuated == 0.5 and common == pytest.approx(3 / 6)
    assert quality.measure(GERMAN)[5] == "de"


def test_divergence():
    assert quality.divergence([1, 0], [0, 1]) == pytest.approx(1) and quality.divergence([0.5, 0.5], [0.5, 0.5]) == 0


def test_frame(spark):
    rows = [(1, PROSE, "x"), (2, None, "x"), (3, "", "x"), (4, " \n\t ", "x"), (1, PROSE, "x"), (None, "…", "x"), (5, "a" * 300_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = quality.text_quality(df, "doc_id", "text").collect()
    assert len(got) == 7
    assert all(r.n_words == 0 and r.kind is None and r.symbol_ratio is None for r in got if r.doc_id in (2, 3, 4))
    assert [r.kind for r in got if r.doc_id == 5] == ["junk"]
    assert quality.text_quality(df.limit(0), "doc_id", "text").count() == 0


def test_random_lower_case_letters_are_junk():
    import random

    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    for text in (
        " ".join(letters(rng.randint(2, 9)) for _ in range(200)),
        ". ".join(" ".join(letters(rng.randint(2, 9)) for _ in range(9)).capitalize() for _ in range(20)) + ".",
        letters(900),
        "\n".join(letters(76) for _ in range(12)),
    ):
        assert quality.measure(text)[-1] == "junk"
    # languages without a profile have no known function words, but letters like a language
    for text in (
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, "
        "ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem "
        "i powinni postępować wobec innych w duchu braterstwa.",
    ):
        assert quality.measure(text)[-1] == "prose"


def test_noise_lines_beside_long_prose_are_junk():
    import base64
    import random

    line = "The committee said that it would look at all of the reports before the end of the year and then write to them again. "
    noise = base64.b64encode(random.Random(2).randbytes(57 * 14)).decode()
    noise = "\n".join(noise[k : k + 76] for k in range(0, len(noise), 76))
    prose = "\n".join([line * 5, line * 5])
    m = quality.matter(noise + "\n" + prose)
    assert m["noise"][0] == 14 and m["prose"][0] == 2
    assert quality.measure(noise + "\n" + prose)[-1] == "junk"


def test_random_letters_at_natural_frequency_are_junk():
    rng = random.Random(5)
    for weights in quality.LETTERS.values():
        letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", weights, k=n))  # noqa: B023, E731
        for text in ("\n".join(letters(90) for _ in range(30)), " ".join(letters(rng.randint(2, 9)) for _ in range(200)), letters(1500)):
            assert quality.measure(text)[-1] == "junk"


def test_word_divergence_tells_prose():
    far = {kind: [quality.measure((t + "\n") * 9)[-2] for t in texts] for kind, texts in CASES.items()}
    assert max(far["prose"][:2]) < 0.08 < min(far["table"])
    assert quality.word_divergence({}, "en", 500) > 0.15 > quality.word_divergence({}, "en", 5)


def test_structure_is_the_nearest_profile():
    for kind, (forms, classes, share) in quality.PROFILES.items():
        assert quality.nearest_structure(forms, quality._normal(classes), quality.word_profile("en", share), "en") == kind
    # between two forms in equal parts the characters and function words decide
    half = [0.5, 0.0, 0.5, 0.0]
    for kind in ("prose", "table"):
        _, classes, share = quality.PROFILES[kind]
        assert quality.nearest_structure(half, quality._normal(classes), quality.word_profile("de", share), "de") == kind


def test_plain_prose_costs_few_divergences(monkeypatch):
    calls = dict.fromkeys(("letter_divergence", "count_characters", "divergence"), 0)
    for name in calls:

        def counted(*args, name=name, real=getattr(quality, name)):
            calls[name] += 1
            return real(*args)

        monkeypatch.setattr(quality, name, counted)
    assert quality.measure("\n\n".join([f"{PROSE} {PROSE}"] * 3))[-1] == "prose"
    # the letters of the text itself; the text and its three lines; two columns, six of profiles and one of each line
    assert calls["letter_divergence"] == 1 and calls["count_characters"] == 4 and calls["divergence"] <= 11


def _odd_texts():
    rng = random.Random(9)
    signs = list(" \t\n\"'|;,.!?…”’»)]}-_İßſΣς½²١中éüñ•ÃÂâ\x80€�─\x85\x0b\x1c\ud800")
    for text in (PROSE, GERMAN, *(t for texts in CASES.values() for t in texts)):
        for n in (0, 3, 40):
            mixed = list(text)
            for _ in range(n):
                mixed.insert(rng.randrange(len(mixed) + 1), rng.choice(signs))
            yield "".join(mixed)
    yield from ("", " ", "\ud800", "a", "é", "-" * 90, "".join(map(chr, range(0x3000))))


def test_shortcuts_give_what_the_definitions_give():
    import re

    vowel = quality._vowel_or_consonant
    for text in _odd_texts():
        assert quality.words_of(text) == re.findall(r"[^\W_]+", text.lower())
        kinds = [vowel(c) if ord(c) < 0x250 else 0 for c in text]
        pairs = [a != b for a, b in zip(kinds, kinds[1:]) if a and b]
        share = sum(pairs) / len(pairs) if pairs else 1
        far = quality.divergence([share, 1 - share], quality.ALTERNATION) if share < quality.ALTERNATION[0] else 0.0
        assert quality.order_divergence(text) == far
        classes, letters = quality.count_characters(text)
        assert classes.tolist() == [sum(quality._class_of(c) == k for c in text) for k in range(7)]
        for piece in (letters, letters // 9):
            far, _, n = quality.letter_divergence(piece)
            if n and quality.letters_are_near(piece, n):
                assert far <= quality.WORDLESS_LIMIT + quality.WORDLESS_GRACE / n
        for line in text.splitlines():
            ends = bool(re.search(r"[.!?…:;,。！？](?:[\"'”’»)\]]*)\s*$", line))
            assert ends == line.rstrip().rstrip(quality._CLOSING).endswith(quality._ENDS)


def test_nearest_structure_is_the_least_of_all():
    rng = random.Random(8)
    for _ in range(300):
        shares = [quality._normal([rng.random() ** 4 + 1e-9 for _ in range(n)]) for n in (4, 7, 4)]
        language = rng.choice(list(quality.LETTERS))
        every = {
            kind: sum(w * quality.divergence(p, q) for w, p, q in zip(quality.WEIGHTS, shares, profile[language]))
            for kind, profile in quality._STRUCTURES.items()
        }
        assert quality.nearest_structure(*shares, language) == min(every, key=every.get)
