import hashlib
from collections import Counter

import pytest

import plain
from casebook.llm import alignment

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
vocabulary = pytest.importorskip("public_tokenizers")

ODD = [
    "a  b\nc\t d  ", " lead", "trail ", " ", "\n", "  \n x", "a \n b", "tab\t x", "nb x  y", "em  x  y", "　wide 　x", "\u0085 x", "x \u0085y", "z\x1c x",
    "<|endoftext|> </s> <s> [INST]", "don't we'll it's", "é é ñ", "漢字 かな カナ", "👩‍👩 ok", "a\x00b \x00", "12345 3.14 1,000", "▁ mark ▁▁x", "a▁b ▁c", "x" * 3000, "а" * 700, "--- *** ===",
]


@pytest.fixture(scope="module")
def wanted():
    a = tokenizers.Tokenizer.from_file(vocabulary.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary.path("piece_bpe_32k.model"))

    def byte_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def run(column):
        out = [plain.aligned(a, b, byte_b, t) for t in column]
        held = Counter(p for _, links in out for p in set(links))
        best = {}
        for (x, _), n in held.items():
            best[x] = max(best.get(x, 0), n)
        rows = []
        for groups, links in out:
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            rows.append((
                sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(held[p] == best[p[0]] for p in links),
                sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else "", text,
            ))
        return rows

    return run


@pytest.mark.parametrize("settings", [{}, {"segment": 300, "known": 20}, {"pairs": 0}])
def test_same_as_plain(llm, texts, wanted, settings):
    column = [*ODD, None, "", texts.prose(400), texts.prose(60), texts.prose(60) + "\n" + "  ".join(ODD), " ".join(ODD), "the same", "the same"]
    df = llm.createDataFrame(list(enumerate(column)), "doc_id bigint, text string")
    rows = alignment.align_documents(df, alignment.AlignSettings(**settings), groups=True).collect()
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in rows}
    for i, want in enumerate(wanted(column)):
        assert got[i] == want, column[i]


def test_not_spelled_alike(wanted):
    # text that the second tokenizer cannot spell has no tokens; its mark is one that it takes for a space
    assert wanted(["a▁b"])[0][:2] == (0, 0) and wanted(["a b"])[0][0] == 2


def test_align():
    groups, links = alignment.align([0, 1, 2], [3, 4], [2, 3, 1, 3, 3], [2, 3, 1, 3, 3])
    assert groups == [(3, 2)] and links == [(0, 0), (1, 0), (1, 1), (2, 1)]


def test_odd_rows(odd):
    out = alignment.align_documents(odd)
    rows = out.collect()
    assert len(rows) == odd.count() and {"score", "hash", "n_words", "label"} <= set(out.columns)
    assert {(r.n_a, r.groups_sha256) for r in rows if r.doc_id in (1, 2)} == {(0, "")}
    clash = odd.withColumnsRenamed({"score": "n_a", "kept": "row", "hash": "link_a", "mark": "a"})
    assert alignment.align_documents(clash).filter("doc_id = 4").first().n_a > 0
    assert alignment.align_documents(odd.select("doc_id", "text").limit(0)).count() == 0
