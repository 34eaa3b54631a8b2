"""Stored examples of conversations."""

from helioframe.llm import chat


def test_examples_are_stored_with_their_context(spark):
    turns = [("user", "a ### b"), ("assistant", "one </turn>"), ("user", "c"), ("system", "d"), ("assistant", "two"), ("user", "tail")]
    rows = [(conv, k, who, text) for conv in (4, None) for k, (who, text) in enumerate(turns)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    pieces = [chat.format_turn(*t)[0] for t in turns]
    for conv in (4, None):
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.example)
        assert [r.text for r in mine] == ["".join(pieces[:n]) for n in (2, 5, 6)]
        assert [r.context_chars for r in mine] == [0, len(mine[0].text), len(mine[1].text)]
        assert [chat.unescape(r.text[r.loss_start:r.loss_end]) for r in mine[:2]] == ["one </turn>", "two"] and mine[2].loss_start is None
