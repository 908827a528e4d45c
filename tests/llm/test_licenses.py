import random
import re

import pytest

from chainloom.llm import common, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def brute_matches(templates, text, least):
    """Pieces found by comparing words at all places."""
    def longest(i, template):
        """Longest piece ending before i, and where it ends in the template."""
        best, ends = 0, []
        for e in range(1, len(template) + 1):
            n = 0
            while n < min(i, e) and text[i - 1 - n] == template[e - 1 - n]:
                n += 1
            if n > best:
                best, ends = n, []
            if n == best and n:
                ends.append(e)
        return best, ends

    found = set()
    for i in range(1, len(text) + 1):
        here = [longest(i, t) for t in templates]
        most = max(n for n, _ in here)
        following = max(longest(i + 1, t)[0] for t in templates) if i < len(text) else 0
        if most >= least and following <= most:
            found |= {(t, i, e, n) for t, (n, ends) in enumerate(here) if n >= least for e in ends}
    return found


@pytest.mark.parametrize("seed", range(25))
def test_matches_equal_brute_force(seed):
    rng = random.Random(seed)
    alphabet = "abcd"[: rng.randint(2, 4)]
    templates = [[rng.choice(alphabet) for _ in range(rng.randint(3, 14))] for _ in range(3)]
    text = [rng.choice(alphabet + "z") for _ in range(60)]
    made = licenses.Scanner([(str(i), " ".join(t)) for i, t in enumerate(templates)], {}, 2, 5, 0.8)
    got = list(made.matches(made.numbers(" ".join(text).encode())))
    assert len(got) == len(set(got)) and set(got) == brute_matches(templates, text, 2)


@pytest.mark.parametrize("seed", range(10))
def test_statistics_equal_brute_force(seed):
    rng = random.Random(seed)
    sequences = [[rng.randint(1, 3) for _ in range(rng.randint(1, 12))] for _ in range(4)]
    text = [rng.randint(1, 4) for _ in range(80)]
    pieces = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    made = licenses.Automaton(sequences)
    for i, (_, length) in enumerate(made.statistics(text), 1):
        assert length == max((n for n in range(i + 1) if tuple(text[i - n : i]) in pieces), default=0)


def scan(text):
    return licenses.scanner(tuple(licenses.TEMPLATES), tuple(licenses.PHRASES.items()), licenses.LEAST, licenses.GAP, licenses.COVERED).scan(text.encode())


@pytest.mark.parametrize("label,wording", licenses.TEMPLATES)
def test_every_template_is_found_in_a_text(label, wording):
    before = "qqq zzz " * 20
    found = scan(before + wording + " qqq zzz" * 20)
    assert label in found["labels"]
    assert any(s["label"] == label and s["covered"] == 1 and s["first_word"] == 40 and s["end_word"] == 40 + len(words(wording)) for s in found["spans"])


def test_edited_wordings():
    label, wording = licenses.TEMPLATES[2]
    parts = wording.split()
    edited = " ".join(w for i, w in enumerate(parts) if i % 17 != 5)  # words left out
    added = " ".join(x for i, w in enumerate(parts) for x in ([w, "qqq", "qqq"] if i % 11 == 5 else [w]))
    assert label in scan(edited)["labels"] and label in scan(added)["labels"]
    half = " ".join(parts[: len(parts) // 2])
    assert label not in scan(half)["labels"] and 0.3 < scan(half)["score"] < 0.7
    apart = " ".join(parts[:20]) + " qqq" * 200 + " " + " ".join(parts[20:])
    assert label not in scan(apart)["labels"] or len(parts[20:]) >= 0.8 * len(parts)


def test_two_copies_are_two_spans():
    label, wording = licenses.TEMPLATES[1]
    spans = scan(f"{wording} {'qqq ' * 60} {wording}")["spans"]
    assert [s["label"] for s in spans] == [label, label] and spans[0]["end_word"] <= spans[1]["first_word"]


def test_base_places_and_cases(spark):
    common.prepare(spark)
    texts = [
        None, "", "  ,;", "The MIT  License; the apache\nLICENSE", "mit licensed", "cc by cc by", "CC-BY 4.0", "gnu general public", "é mit license", "émit license",
        "GNU General Public License", "x" * 3_000_000, "word " * 400_000 + "MIT License", None, "cc by cc by",
    ]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, scan string, n_words long")
    got = {r.doc_id: r for r in licenses.with_scan(df).collect()}
    for i, text in enumerate(texts):
        seen = words(text or "")
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(seen)) if seen[k : k + len(phrase.split())] == phrase.split()]
        r = got[i].scan
        assert (r.n_words, r.n_base) == (len(seen), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == sorted({label for _, label in places}) and set(r.base_labels) <= set(r.labels)
        assert 0 <= r.score <= 1 and got[i].n_words == i
    assert licenses.with_scan(df.where("false")).collect() == []


def test_pieces_join_without_a_seam(monkeypatch):
    text = " ".join(w for _, wording in licenses.TEMPLATES for w in wording.split()).encode()
    whole = scan(text.decode())
    monkeypatch.setattr(licenses, "PIECE", 7)
    assert scan(text.decode()) == whole
