from strandwork.llm import chat_format as S

TURNS = "conv_id bigint, turn bigint, role string, text string, part string, speaker int"


def place(turn, span):
    return 0 if span == 1 << 40 else None if turn is None else turn // span


def brute(rows, span=1 << 40):
    own = [(c, t, r or "unknown", x or "") for c, t, r, x in rows]
    out = []
    for conv in {r[0] for r in own}:
        mine = [r for r in own if r[0] == conv]
        for speaker in {r[2] for r in mine} - {"system"}:
            for part in {place(r[1], span) for r in mine}:
                text, mask = "", []
                here = sorted((r for r in mine if place(r[1], span) == part), key=lambda r: (-1 if r[1] is None else r[1], r[2].encode(), r[3].encode()))
                for _, _, role, x in here:
                    name = "system" if role == "system" else "assistant" if role == speaker else f"user name={role}"
                    text += f"<|im_start|>{name}\n"
                    if role == speaker:
                        mask.append((len(text), len(text) + len(x) + len("<|im_end|>")))
                    text += f"{x}<|im_end|>\n"
                out.append((str(conv), speaker, str(part), len(here), text, mask))
    return sorted(out)


def found(spark, rows, **options):
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    return sorted((str(r.conv_id), r.speaker, str(r.part), r.n_messages, r.rendered, [tuple(s) for s in r.mask]) for r in S.perspectives(turns, **options).collect())


def test_every_participant_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi 😀"), (1, 2, "bob", "ho"), (1, 3, "ann", ""), (1, 4, "eve", None), (2, 0, "system", "alone"), (3, 5, None, "who"), (3, 5, "user", "tie b"), (3, 5, "user", "tie a"), (3, 5, "user", "tie a"), (3, None, "user", "late"), (None, 0, "user", "no name"), (None, 1, "assistant", "x")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, span=4) == brute(rows, 4)
    spans = {r[1]: [r[4][a:b] for a, b in r[5]] for r in found(spark, rows) if r[0] == "1"}
    assert spans == {"ann": ["hi 😀<|im_end|>", "<|im_end|>"], "bob": ["ho<|im_end|>"], "eve": ["<|im_end|>"]}


def test_long_conversations_come_in_parts_that_join(spark):
    rows = [(9, t, ("a", "b", "c")[t % 3], f"t{t}") for t in range(500)]
    got = found(spark, rows, span=7)
    assert got == brute(rows, 7)
    whole = found(spark, rows)
    for speaker in "abc":
        joined = "".join(x[4] for x in sorted((r for r in got if r[1] == speaker), key=lambda r: int(r[2])))
        assert joined == next(r[4] for r in whole if r[1] == speaker)


def test_empty_table(spark):
    assert S.perspectives(spark.createDataFrame([], TURNS)).count() == 0
