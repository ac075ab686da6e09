import collections
import random
import re
import sys
from pathlib import Path

from cases import documents, frame, prose, save, with_clashes
from tractlake.llm.lines import OP4_SQL, drop_repeated, op4_line_dedup

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import connect, differences  # noqa: E402

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, least):
    """Texts by (id, text): a line goes if it is in a run of enough words that stands earlier."""
    docs = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda d: d[:2])
    lines = {}
    for d in docs:
        raw = d[2].split("\n")
        lines[d] = raw, [(p, x.strip(" \t\x0b\f\r"), len(WORDS.findall(x))) for p, x in enumerate(raw) if WORDS.search(x)]
    seen, gone = set(), collections.defaultdict(set)
    for d in docs:
        some = lines[d][1]
        for a in range(len(some)):
            for b in range(a, len(some)):
                if sum(n for _, _, n in some[a : b + 1]) >= least:
                    content = tuple(x for _, x, _ in some[a : b + 1])
                    if content in seen:
                        gone[d] |= set(range(some[a][0], some[b][0] + 1))
                    seen.add(content)
    return {(d[1] if d[0] else None, d[2]): "\n".join(x for p, x in enumerate(raw) if p not in gone[d]) for d, (raw, _) in lines.items()}


def corpus(seed):
    """Documents of lines that are often the same, in runs that are often the same."""
    rng = random.Random(seed)
    pool = [prose(rng, rng.randrange(1, 9)).replace("\n", " ") for _ in range(12)]
    passages = [[prose(rng, 7).replace("\n", " ") for _ in range(rng.randrange(2, 6))] for _ in range(4)]
    rows = []
    for i in range(50):
        text = []
        for _ in range(rng.randrange(1, 6)):
            text += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(pool) if rng.random() < 0.4 else prose(rng, 6).replace("\n", " ")]
            text += [""] * (rng.random() < 0.2)
        rows.append((None if i == 7 else i, rng.choice(["\n", "\n", " \r\n"]).join(text)))
    return rows + [(60, rows[3][1]), (3, rows[3][1]), (61, None), (62, ""), (63, " \n "), (64, "\n".join([pool[0]] * 30))]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = with_clashes(frame(spark, [(i, t, "en", "s", 5) for i, t in rows]))
        out = drop_repeated(docs, least=12)
        assert out.columns == docs.columns
        wanted = brute(rows, 12)
        expected = collections.Counter((i, None if t is None else wanted[i, t]) for i, t in rows)
        got = out.collect()
        assert collections.Counter((r.doc_id, r.text) for r in got) == expected
        original = dict(rows)
        for r in got:
            assert r.n_chars == (5 if r.text == original[r.doc_id] else len(r.text))


def test_awkward_rows(spark, tmp_path):
    rows = documents()
    save(with_clashes(frame(spark, rows)).repartition(3), tmp_path)
    out = drop_repeated(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    wanted = brute([r[:2] for r in rows], 50)
    expected = collections.Counter((i, None if t is None else wanted[i, t]) for i, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == expected
    assert op4_line_dedup(spark, str(tmp_path)).count() == len(rows)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert differences(op4_line_dedup(spark, folder), connect(folder), OP4_SQL) == []


def test_empty_table(spark, tmp_path):
    assert op4_line_dedup(spark, save(frame(spark, []), tmp_path)).collect() == []
