import pytest

from sitefacts.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, hash long, thread string, up string, position int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA)


@pytest.mark.parametrize(
    ("text", "own", "levels", "passages"),
    [
        (None, "", [], 0), ("", "", [], 0), ("  plain\ntext ", "plain\ntext", [], 0), ("> a\n> b\n\nc", "c", [1, 1], 1),
        ("Ann wrote:\n> a\n> > b\n>> c\n>d\nno", "no", [1, 2, 2, 1], 3), ("one\n> q\ntwo\n> r\nthree", "one\n\ntwo\n\nthree", [1, 1], 2),
        ("a > b\n1 > 0", "a > b\n1 > 0", [], 0), ("> only", "", [1], 1), ("On Monday B wrote:\r\n> x\r\ny", "y", [1], 1), (">\n> \nz", "z", [], 1),
        ("he wrote:\nnothing", "he wrote:\nnothing", [], 0), ("\n\na\n\n\nb", "a\n\n\nb", [], 0),
    ],
)
def test_split_quotes(text, own, levels, passages):
    clean, quoted, _, count = chat.split_quotes(text)
    assert (clean, [q[0] for q in quoted], count) == (own, levels, passages)


def test_normalised_lines_match():
    assert chat.line_hash("  Hello,   World! ") == chat.line_hash("hello world") != chat.line_hash("hello worlds")
    assert chat.line_hash("***") != chat.line_hash("---")


def test_threads(spark):
    rows = [
        (1, 0, "user", "First words\nsecond line"),
        (1, 1, "assistant", "> First words\n> second line\n\nAn answer"),
        (1, 2, "user", "A wrote:\n> FIRST   words!\n\nAnother answer"),
        (1, 3, "user", "> An answer\n> > First words\n\nAnd more"),
        (1, 4, "user", "no quote"),
        (1, 5, "user", "> nobody said this\nx"),
        (1, 6, "user", "> First words\n> Another answer\nmost of it"),
        (2, 7, None, "> First words\nother conversation"),
        (2, 7, "user", None), (None, 3, "user", "> First words\na"), (3, None, "user", "b"),
    ]
    got = sorted((tuple(r) for r in chat.chats(frame(spark, rows)).collect()), key=str)
    want = [
        (1, 0, "user", None, False, 0, 0, 0, 0, "First words\nsecond line"),
        (1, 1, "assistant", 0, True, 0, 1, 1, 1, "An answer"),
        (1, 2, "user", 0, True, 0, 1, 2, 1, "Another answer"),
        (1, 3, "user", 1, True, 0, 2, 3, 2, "And more"),
        (1, 4, "user", 3, False, 0, 3, 4, 0, "no quote"),
        (1, 5, "user", 4, False, 0, 4, 5, 1, "x"),
        (1, 6, "user", 2, True, 0, 2, 6, 1, "most of it"),
        (2, 7, None, None, False, 7, 0, 0, 1, "other conversation"),
        (2, 7, "user", None, False, 7, 0, 0, 0, ""),
        (None, 3, "user", None, False, None, 0, 0, 1, "a"),
        (3, None, "user", None, False, None, 0, 0, 0, "b"),
    ]
    assert got == sorted(want, key=str)
    assert chat.chats(frame(spark, [])).count() == 0


def test_long_conversation_of_equal_lines(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 16)
    rows = [(1, k, "user", "ok" if k == 0 else "> ok\n\nok") for k in range(200)]
    got = {r.turn: r for r in chat.chats(frame(spark, rows)).collect()}
    assert all(got[k].reply_to == k - 1 and got[k].depth == k and got[k].position == k and got[k].thread == 0 for k in range(1, 200))


def test_mails_of_long_conversations(spark, monkeypatch):
    """Numbered by parts of turns: every message quotes the right ones, at any length."""
    monkeypatch.setattr(chat, "PART", 8)
    rows = [(c, 2 * k + c, "user", f"text {c} {k}\nline" if k % 7 else None) for c in (1, 2) for k in range(60)]
    rows += [(None, 1, "user", "alone"), (1, None, "user", "no turn")]
    got = {(r.conv_id, r.turn): r.text for r in chat.as_mails(frame(spark, rows).repartition(5)).collect()}
    assert len(got) == len(rows) and got[(None, 1)] == "alone" and got[(1, None)] == "no turn"
    quote = lambda text, mark: "\n".join(mark + line for line in text.split("\n")) if text else ""
    for c in (1, 2):
        texts = [r[3] or "" for r in rows if r[0] == c and r[1] is not None]
        for k, text in enumerate(texts):
            back = 2 if (2 * k + c) % 3 == 2 else 1
            up = texts[k - back] if k >= back else None
            further = texts[k - back - 1] if k > back else None
            nested = "\n" + quote(further, "> > ") if further is not None else ""
            want = text if up is None else f"Someone wrote:\n{quote(up, '> ')}{nested}\n\n{text}"
            assert got[(c, 2 * k + c)] == want
