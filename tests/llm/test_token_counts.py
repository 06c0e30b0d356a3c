import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tripweave.llm import token_counts as tc

TEXTS = ["", "Hello world", "a\n\nb", "naïve café — 漢字かな交じり文 😀😀 done\nnext  line\r\n\ttab", "x" * 500, "1234567890 " * 30, "Don't stop; it's   fine.\n" * 8]


@pytest.fixture(scope="module")
def encoder():
    return tc.Encoder(tc._read(None, tc.VOCABULARY), tc._pattern())


def plain(borders, begins, ends, rule):
    k = len(begins)
    owner = {}
    for j, (a, b) in enumerate(zip(begins, ends)):
        owner.update({x: j for x in range(a, b)})
    counts, crossing, outside = [0.0] * k, [0] * k, 0.0
    for a, b in zip(borders, borders[1:]):
        pieces = []
        for x in range(a, b):
            o = owner.get(x)
            if pieces and pieces[-1][1] == o:
                pieces[-1][0] += 1
            else:
                pieces.append([1, o])
        if len(pieces) > 1:
            for o in {p[1] for p in pieces} - {None}:
                crossing[o] += 1
        shares = {
            "first": [(1, pieces[0][1])], "last": [(1, pieces[-1][1])], "most": [(1, max(pieces, key=lambda p: p[0])[1])],
            "split": [(n / (b - a), o) for n, o in pieces],
        }[rule]
        for n, o in shares:
            if o is None:
                outside += n
            else:
                counts[o] += n
    return counts, crossing, outside


@pytest.mark.parametrize("rule", tc.RULES)
def test_allocation_is_the_plain_one(rule):
    rng = random.Random(rule)
    for _ in range(300):
        borders = [0]
        for _ in range(rng.randint(0, 12)):
            borders.append(borders[-1] + rng.randint(1, 9))
        cuts = sorted(rng.randint(0, borders[-1]) for _ in range(2 * rng.randint(0, 5)))
        begins, ends = cuts[::2], cuts[1::2]
        pairs = [(a, b) for a, b in zip(begins, ends) if a < b]
        begins, ends = np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64)
        counts, crossing, outside = tc.allocate(np.array(borders), begins, ends, rule)
        want = plain(borders, begins.tolist(), ends.tolist(), rule)
        assert counts.tolist() == pytest.approx(want[0]) and crossing.tolist() == want[1] and outside == pytest.approx(want[2])


def test_offsets_agree_with_another_library(encoder):
    import public_tokenizers

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in TEXTS:
        theirs = other.encode(text, add_special_tokens=False)
        assert len(theirs.ids) == len(encoder.borders(text)) - 1
        assert encoder.borders(text)[-1] == len(text.encode())
        if text.isascii():  # other libraries may trim the space before a word; compare the ends
            assert [b for _, b in tc.character_spans(text, encoder.borders(text))] == [b for _, b in theirs.offsets]


def test_rows_add_up(spark, odd, no_docs):
    for rule in tc.RULES:
        rows = tc.tokens_by_section(odd, rule=rule).collect()
        sums = {}
        for r in rows:
            sums.setdefault((r.doc_id, r.doc_tokens), []).append(r.tokens)
        for (doc, total), parts in sums.items():
            assert sum(parts) == pytest.approx(total * (2 if doc == 6 else 1)) or doc is None
    empty = [r for r in rows if r.doc_id in (1, 2, 9)]
    assert len(empty) == 3 and all(r.section is None and r.tokens == 0 for r in empty)
    assert tc.tokens_by_section(no_docs).count() == 0
    with pytest.raises(ValueError):
        tc.tokens_by_section(odd, rule="other")


def test_lines_tile_the_text():
    for text in TEXTS:
        spans = tc.lines(text)
        assert "".join(text[a:b] for a, b in spans) == text and all(a < b for a, b in spans)
