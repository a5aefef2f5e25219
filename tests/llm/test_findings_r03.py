"""Findings of round 3."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from hazmill.llm import neardup, queries, tokenbin


def test_rows_of_a_bucket_are_made_once(spark):
    """what makes the rows of blocks (joins) ran once for members and once more for visitors."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(3)
    comp = rng.integers(0, 6, 400)
    table = [(int(i) % 2, 3, 2, bool(comp[i]), int(i), int(comp[i])) for i in range(400)]
    df = spark.createDataFrame(table, "key long, own long, other long, visits boolean, node long, comp long").mapInArrow(counted, "key long, own long, other long, visits boolean, node long, comp long")
    groups: dict[tuple, tuple[list, list]] = {}
    for r in neardup._dealt(df, []).collect():
        groups.setdefault((r.key, r.i, r.j), ([], []))[r.visitor].append(r.node)
    met = Counter((a, b) for members, visitors in groups.values() for a in members for b in visitors)
    want = {(a[4], b[4]) for a in table for b in table if a[0] == b[0] and b[3]}
    assert set(met) == want and set(met.values()) == {1}  # each member meets each visitor of its bucket, in one group
    assert made.value == len(table)


def test_simple_words_are_cut_without_the_library(monkeypatch):
    """words of letters, digits and marks took a call of the library each, accented ones its normaliser and splitter."""
    e = tokenbin.WordEncoder(queries.tokenizer("word_bpe_49k.json"))
    rng, called = random.Random(5), []
    for name in ("_one_by_one", "_plain"):
        own = getattr(e, name)
        monkeypatch.setattr(e, name, lambda x, own=own: (called.extend(x if isinstance(x, list) else [x]), own(x))[1])
    simple = ["onhaes,%%%", "555-8136", "ÈPA!!", "öchö.###", "(see", "Étéß", "x" * 5000, "é9" * 500, "0", "$$$", "«"]
    wild = [chr(c) for c in range(256)] + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "Σ", "ς", "İ", "ẞ", "\u0331", "\u0301", "\u2028", "\u200b", "中", "мир", "٣", "😀", "\ufb01"]
    texts = simple[:-1] + ["".join(rng.choice(wild) if rng.random() < 0.5 else rng.choice("abcdeéüñABÉ .,!9") for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    e.learn(simple)
    assert set(called) <= {"«"}
    ids, sizes = e.encode(pa.array(texts, pa.large_string()))
    want = [x.ids for x in e.lib.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
