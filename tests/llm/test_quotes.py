"""Quotation linking on generated conversations with nested quotes, against the query's SQL and a plain loop."""

import random

import duckdb
import pytest

from pairlattice.llm import quotation

WORDS = "amber brick cedar delta ember field grove haven inlet jetty knoll ledge maple night ocean pearl quiet river stone thorn".split()


def conversations(seed, sizes):
    """Rows (conv_id, turn, role, text) and what each message answers. Every own line stands once in the table."""
    rng, rows, answers, n = random.Random(seed), [], {}, 0
    for conv, size in enumerate(sizes):
        texts = []  # own lines and quoted lines with their level, of each message
        for turn in range(size):
            own = []
            for _ in range(rng.randint(1, 4)):
                n += 1
                own.append(f"{rng.choice(WORDS).capitalize()}  {rng.choice(WORDS)} line {n}")
            quoted = []
            if turn and rng.random() < 0.75:
                up = rng.randrange(max(0, turn - 20), turn)
                answers[conv, turn] = up
                quoted = [(1, x) for x in texts[up][0]] + [(level + 1, x) for level, x in texts[up][1]]  # a reply quotes the whole message
            if rng.random() < 0.1:
                quoted.append((1, f"of unknown origin {rng.random()}"))
            texts.append((own, quoted))
            lines = [rng.choice(["> ", ">"]) * level + (x.lower() if rng.random() < 0.5 else x) for level, x in quoted] + own
            rows.append((conv, turn, "user" if turn % 2 else "assistant", "\n".join(lines)))
    return rows, answers


@pytest.mark.parametrize("sizes", [[12] * 40, [700] + [20] * 60])
def test_generated_quotes_are_linked_as_the_sql_links_them(spark, tmp_path, sizes):
    rows, answers = conversations(len(sizes), sizes)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = quotation.query(spark, str(tmp_path)).collect()
    assert {(r["conv_id"], r["turn"]): r["parent_turn"] for r in got if r["parent_turn"] is not None} == answers and len(answers) > 300
    assert all(not line.lstrip().startswith(">") for r in got for line in r["own_text"].split("\n"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(quotation.ORACLE)
    names = [c[0] for c in found.description]
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted(found.fetchall(), key=str)


def same_as_the_sql(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = quotation.query(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(quotation.ORACLE)
    names = [c[0] for c in found.description]
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted(found.fetchall(), key=str)
    return {(r["conv_id"], r["turn"]): r for r in got}


ALPHA = "Alpha line one, which is long\nand goes on here.\n\nA second paragraph of the message\nstands below it."


def test_quotes_that_a_mail_program_wrapped_anew(spark, tmp_path):
    rows = [
        (1, 0, "u", ALPHA), (1, 1, "u", "Another message,\nabout other things."),
        (1, 2, "a", "On Monday u wrote:\n> Alpha line one,\n> which is long and\n> goes on here.\nYes."),
        (1, 3, "a", "Am Montag schrieb u:\n\n> A second paragraph of the message stands below it.\n> \n> Alpha line one, which is long and goes on here.\nNo."),
        (1, 4, "a", "> > Alpha line one, which is\n> > long and goes on here.\n> Yes.\nWell."),
        (1, 5, "a", "> a second paragraph of the message stands\n> somewhere\nShingles."), (1, 6, "a", "> about it\nShort."), (1, 7, "a", "She wrote:\nnothing quoted"),
    ]
    got = same_as_the_sql(spark, tmp_path, rows)
    assert [got[1, t]["parent_turn"] for t in range(8)] == [None, None, 0, 0, 2, 0, None, None]
    assert [got[1, t]["n_linked"] for t in range(8)] == [0, 0, 3, 2, 3, 2, 0, 0]
    assert [got[1, t]["own_text"] for t in (2, 3, 4, 5, 7)] == ["Yes.", "\nNo.", "Well.", "Shingles.", "She wrote:\nnothing quoted"]


def test_shared_lines_wrapped_anew_against_the_sql(spark, tmp_path):
    rng, rows = random.Random(5), [(2, None, "u", "> x y"), (None, 1, "u", "> x y"), (3, 0, "u", None), (3, 1, "u", "")]
    for conv in (10, 11):
        texts = []
        for turn in range(150):
            words = [rng.choice(WORDS[:12]) for _ in range(rng.randint(1, 30))]
            wrap = lambda mark, w, k: "\n".join(mark + " ".join(w[i : i + k]) for i in range(0, len(w), k))
            body = wrap("", words, rng.randint(3, 9))
            if texts and rng.random() < 0.8:
                up = rng.choice(texts)
                part = up if rng.random() < 0.6 else up[rng.randrange(len(up)) :]
                body = rng.choice(["", "u wrote:\n", "u wrote:\n\n"]) + wrap(rng.choice(["> ", ">> "]), part, rng.randint(3, 9)) + "\n" + body
            texts.append(words)
            rows.append((conv, turn, "u", body))
            if rng.random() < 0.05:
                rows.append((conv, turn, "u", body))
    got = same_as_the_sql(spark, tmp_path, rows)
    assert sum(r["parent_turn"] is not None for r in got.values()) > 150


def test_threads_follow_the_answers(spark):
    rows, answers = conversations(3, [90, 15])
    got = {(r["conv_id"], r["turn"]): r for r in quotation.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}

    def root(conv, turn):
        while (conv, turn) in answers:
            turn = answers[conv, turn]
        return turn

    assert all(r["thread_turn"] == root(*key) for key, r in got.items())
    for conv in (0, 1):
        order = sorted((r for r in got.values() if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in order] == list(range(1, len(order) + 1))
        assert [(r["thread_turn"], r["turn"]) for r in order] == sorted((r["thread_turn"], r["turn"]) for r in order)
