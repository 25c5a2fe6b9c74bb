import random
import re
from collections import Counter

from harbinger.llm.repetition import LINE_CHARS, NGRAMS, TOP_NGRAMS, repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        own = WORD.findall(line)
        if own:
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, own))
            seen.add(line)

    def inside(n):
        count = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        return {i + k for i in range(len(words) - n + 1) if count[tuple(words[i : i + n])] > 1 for k in range(n)}, count

    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    out |= {"n_dup_lines": dup, "n_repeat_words": len(inside(5)[0]), "dup_line_chars": dup_chars}
    for n in NGRAMS:
        out[f"dup_chars_{n}"] = sum(len(words[i]) for i in inside(n)[0])
    for n in TOP_NGRAMS:
        out[f"top_chars_{n}"] = max((c * sum(map(len, g)) for g, c in inside(n)[1].items() if c > 1), default=0)
    out["base_failed"] = out["n_words"] < 10 or 100 * out["n_repeat_words"] > 20 * out["n_words"]
    over = 100 * dup_chars > LINE_CHARS * out["word_chars"]
    over |= any(100 * out[f"dup_chars_{n}"] > v * out["word_chars"] for n, v in NGRAMS.items())
    over |= any(100 * out[f"top_chars_{n}"] > v * out["word_chars"] for n, v in TOP_NGRAMS.items())
    out["kept"] = not out["base_failed"] and not over
    return out


def test_equals_counting(spark):
    draw = random.Random(8)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "a b\u0085c é#é"), (4, "x " * 4000)]
    for i in range(5, 80):
        vocab = [f"w{k}é" for k in range(draw.choice([3, 20, 900]))] + ["%", "a|b"]
        words = draw.choices(vocab, k=draw.randint(1, 200))
        rows.append((i, "".join(w + draw.choice([" ", "  ", "\n", "\t"]) for w in words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for r in repetition(frame).collect():
        got = r.asDict()
        text = dict(rows)[got.pop("doc_id")]
        assert got == brute(text)


def test_odd_rows(documents, empty):
    out = repetition(documents).collect()
    assert len(out) == documents.count()
    assert all(r.base_failed and not r.kept for r in out if r.doc_id in (4, 5, 6))
    assert repetition(empty).collect() == []
