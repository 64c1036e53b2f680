import itertools
import random
import re

import pytest

from nodeweft.llm import conversations, pair_defects
from nodeweft.llm.pair_defects import defects

Q = "Which function handles /page/list?"
GOOD = "The page is handled by `render` in app/page.py. It reads two tables."


@pytest.mark.parametrize("answer", [None, "", " \t\n", "​", " ​ ", "-", "**", "...", "```\n```", "null", "None", "N/A", "(no answer)", "[empty]", "<p></p>", '{"type":"answer","content":"  ","detail":""}', '{"type": "answer", "content": null}', "sin respuesta"])
def test_empty(answer):
    assert defects(Q, answer, None) == ["empty"]


@pytest.mark.parametrize("answer", [GOOD, "Yes.", "12", "`render`", "Only ADM.", "None; nothing calls it.", "No, never.", "It is in\napp/page.py", "It does.\n\n```php\n$a = f();\n```", "It calls two.\n\n- `a`\n- `b`", "The file is app/page.py", "I could not find a caller of `f` in the graph, so it looks safe to remove.", "Do you mean `a` or `b`?", "Sorry for the delay: the page is handled by `render`.", "I can't see the runtime, but from the graph: `render` handles it.", "No callers found.", '{"type":"answer","content":"It is `render`.","detail":""}', 'He said "no way".'])
def test_sound(answer):
    assert defects(Q, answer, None) == []


@pytest.mark.parametrize("answer", ["The page is handled by", "The page is handled by `ren", "The page is han", 'It is called "the', "It works (see", "It does.\n\n```php\n$a = f(", "It calls two.\n\n- `a`\n- `", '{"type":"answer","content":"It is handled by the', "It holds for the graph as it was ...", "See below:", "The function is called once, and", "This file ren"])
def test_truncated(answer):
    assert defects(Q, answer, None) == ["truncated"]


@pytest.mark.parametrize(
    "answer",
    ["I can't help with that.", "I'm sorry, but I cannot answer this.", "I would prefer not to say who may open /page/list. Is there something else?", "My apologies. Discussing this is not something I can do.", "No comment on this; I have to pass.", "This request goes against my guidelines.", "That is outside of what I am allowed to discuss."]
    + ["As an assistant I must decline this request.", "I have been told not to discuss `f`, since it is internal. Please ask your administrator."],
)
def test_refusal(answer):
    assert defects(Q, answer, None) == ["refusal"]


@pytest.mark.parametrize("answer", ["Je ne peux pas répondre à cette demande.", "Lo siento, pero no puedo ayudarte con eso.", "Es tut mir leid, dabei kann ich nicht helfen.", "Não tenho permissão para responder a essa pergunta.", "Mi dispiace, ma non posso aiutarti con questo."])
def test_refusal_in_other_languages(answer):
    assert defects(Q, answer, None)[0] == "refusal"


@pytest.mark.parametrize("answer", [Q, Q.upper(), "  which  function handles /page/list ", f"Q: {Q}", f"Question: {Q}\nAnswer: {Q}", f"**{Q}**", f"> {Q}", f"{Q}\n{Q}", f'"{Q}"', f"You asked: {Q}"])
def test_copy(answer):
    assert defects(Q, answer, None)[0] == "copy"
    assert defects("", answer, Q)[0] == "copy" and defects("(image)", answer, Q)[0] == "copy"


FRENCH = "La fonction est appelée par trois autres fonctions, dont la plus proche est dans le même module."


def test_language():
    assert defects(Q, FRENCH, None) == ["language"]
    assert defects(Q + " Please answer in French.", FRENCH, None) == []
    assert defects("Quelle fonction traite la page ?", FRENCH, None) == []
    assert defects("Quelle fonction traite la page ?", GOOD, None) == ["language"]
    assert defects(Q, "Функция вызывается из другого модуля.", None) == ["language"]
    assert defects(None, FRENCH, None) == [] and defects("render()", FRENCH, None) == []


def test_long_texts_are_read_whole():
    assert defects(Q, "It works well. " * 20000, None) == []
    assert defects(Q, "It works well. " * 20000 + "And then the", None) == ["truncated"]


MESSAGES = "id long, chat_id string, seq long, question string, answer string, context_question string, created_at double, extra string"


def test_defective_rows(spark, rows):
    data = [(1, "c", 0, Q, None, None, 1.0, "x"), (1, "c", 0, Q, None, None, 1.0, "x"), (2, "c", 1, Q, GOOD, None, 1.0, None), (3, None, None, None, "I can't help with that.", None, None, None), (None, "c", 2, Q, "", None, 1.0, None)]
    df = spark.createDataFrame(data, MESSAGES)
    assert rows(pair_defects.defective(df)) == sorted([(1, "empty"), (3, "refusal"), (None, "empty")], key=repr)
    assert pair_defects.defective(df.limit(0)).count() == 0


def brute(messages, chats):
    out = []
    for chat, group in itertools.groupby(sorted((m for m in messages if m[1] is not None), key=lambda m: m[1]), key=lambda m: m[1]):
        group = list(group)
        if chat not in chats or any(m[2] is None or m[2] < 0 for m in group):
            continue
        held = {}
        for m in sorted(group, key=lambda m: (m[6], m[0])):
            held[m[2]] = m
        turns = [held[s] for s in sorted(held)]
        bad = any(b[6] < a[6] for a, b in zip(turns, turns[1:], strict=False)) or any(defects(m[3], m[4], m[5]) == ["empty"] or not (pair_defects.visible(m[3]) or pair_defects.visible(m[5])) for m in turns)
        if not bad:
            out.append((chat, ",".join(str(m[0]) for m in turns)))
    return sorted(out)


def test_conversations_equal_brute_force(spark, rows):
    rng = random.Random(11)
    messages = []
    for k in range(400):
        chat = rng.choice(["hot"] * 3 + [f"c{i}" for i in range(60)] + [None])
        seq = rng.choice([None, -1]) if rng.random() < 0.004 else rng.randrange(12)
        at = float(seq or 0) * 10 + rng.random() * (30 if rng.random() < 0.05 else 1)
        messages.append((k, chat, seq, rng.choice([Q] * 15 + ["", None]), rng.choice([GOOD] * 40 + [""]), rng.choice([None, Q]), at, "x"))
    messages += messages[:20] + [(1000 + i, "long", i, Q, GOOD, None, float(i), None) for i in range(5000)] + [(7000 + i, "back", i, Q, GOOD, None, float(i - 2 * (i == 2048)), None) for i in range(3000)]
    known = [f"c{i}" for i in range(50)] + ["hot", "long", "back"]
    df = spark.createDataFrame(messages, MESSAGES)
    chats = spark.createDataFrame([(c, "t") for c in [*known, "empty", "c1", None]], "id string, title string")
    want = brute(messages, set(known))
    assert rows(conversations.whole_conversations(df, chats)) == want and any(c == "long" for c, _ in want)
    assert [c for c, _ in rows(conversations.conversations(df, chats, block=7).where("rejected is null"), "chat_id", "ids")] == [c for c, _ in want]
    assert conversations.whole_conversations(df.limit(0), chats).count() == 0


def test_turns_have_roles(spark, rows):
    df = spark.createDataFrame([(1, "c", 0, "", GOOD, Q, 1.0, None), (2, "c", 3, Q, "Yes.", None, 2.0, None)], MESSAGES)
    chats = spark.createDataFrame([("c",)], "id string")
    assert rows(conversations.conversation_turns(df, chats), "seq", "role", "text") == [(0, "assistant", GOOD), (0, "user", Q), (3, "assistant", "Yes."), (3, "user", Q)]
    why = {r["chat_id"]: r for r in conversations.conversations(df.unionByName(df.replace("c", "d")), chats).collect()}
    assert why["d"]["rejected"] == "unknown chat" and why["c"]["offset"] == 0.0


def test_offset_of_infeasible_orders(spark):
    """Stamps 10, 4: the answer to the first turn pulls by 6, both questions hold at 0, so 6 / 3 balances them. Stamps 200,
    100, 99.9: the step of 0.1 is satisfied at 100 / 4 and doesn't count."""
    data = [(1, "c", 0, 10.0), (2, "c", 1, 4.0), (3, "d", 0, None), (4, "e", 0, 200.0), (5, "e", 1, 100.0), (6, "e", 2, 99.9), (7, "f", 0, 1.0), (8, "f", 1, None), (9, "f", 2, 3.0), (10, "g", 0, float("nan")), (11, None, 0, 1.0)]
    df = spark.createDataFrame([(i, c, s, Q, GOOD, None, at, None) for i, c, s, at in data], MESSAGES)
    chats = spark.createDataFrame([(c,) for c in "cdefg"], "id string")
    for block in (1, 1024):
        got = {r["chat_id"]: round(r["offset"], 9) for r in conversations.clock_offsets(df, chats, block=block).collect()}
        assert got == {"c": 2.0, "d": 0.0, "e": 25.0, "f": 0.0, "g": 0.0}
        why = {r["chat_id"]: r["rejected"] for r in conversations.conversations(df, chats, block=block).collect()}
        assert why == {"c": "infeasible order", "d": None, "e": "infeasible order", "f": "infeasible order", "g": None}


def squares(d, uppers, lowers):
    return sum(max(0, d - u) ** 2 for u in uppers) + sum(max(0, x - d) ** 2 for x in lowers)


def test_offsets_are_least_squares(spark):
    """Against a search for the minimum, with two stamps a turn and in blocks of any size."""
    rng = random.Random(5)
    data, want = [], {}
    for c in range(30):
        count = rng.randrange(1, 9)
        q = [10.0 * i + rng.random() for i in range(count)]
        a = [t + rng.uniform(-20, 20) for t in q]
        data += [(100 * c + i, f"c{c}", i, Q, GOOD, None, q[i], a[i]) for i in range(count)]
        uppers, lowers = [x - t for x, t in zip(a, q, strict=True)], [x - t for x, t in zip(a, q[1:], strict=False)]
        low, high = -1000.0, 1000.0
        for _ in range(200):
            x, y = low + (high - low) / 3, high - (high - low) / 3
            low, high = (low, y) if squares(x, uppers, lowers) <= squares(y, uppers, lowers) else (x, high)
        want[f"c{c}"] = (squares(low, uppers, lowers), uppers, lowers)
    df = spark.createDataFrame(data, "id long, chat_id string, seq long, question string, answer string, context_question string, asked double, answered double")
    chats = spark.createDataFrame([(c,) for c in want], "id string")
    for block in (1, 2, 1024):
        got = conversations.clock_offsets(df, chats, block=block, asked_at="asked", answered_at="answered").collect()
        assert len(got) == 30 and any(r["residual"] > 0 for r in got) and any(r["residual"] == 0 for r in got)
        for r in got:
            least, uppers, lowers = want[r["chat_id"]]
            assert abs(squares(r["offset"], uppers, lowers) - least) < 1e-6 and abs(r["residual"] - least) < 1e-6


def test_answers_on_a_shifted_clock_are_merged(spark):
    """The assistant's clock is an hour behind; one row for each sender's message."""
    rows = [(2 * i + k, "c", i, who, f"{who} says a word {i}.", 100.0 * i + 30.0 * k - 3600.0 * k) for i in range(4) for k, who in enumerate(("user", "assistant"))]
    rows += [(90, "c", 0, "system", "x", 0.0), (91, "c", 2, "user", "an earlier form", 1.0)]
    turned = conversations.paired(spark.createDataFrame(rows, "id long, chat_id string, seq long, sender string, text string, created_at double"))
    chats = spark.createDataFrame([("c",)], "id string")
    got = conversations.conversation_turns(turned, chats, asked_at="asked_at", answered_at="answered_at").orderBy("at", "seq", "turn").collect()
    assert [(r["seq"], r["role"]) for r in got] == [(i, who) for i in range(4) for who in ("user", "assistant")]
    # Offsets from -3670 to -3570 order the turns; the one nearest to 0 is taken.
    assert got[1]["at"] - rows[1][5] == 3570.0 and [r["at"] for r in got] == sorted(r["at"] for r in got)


def written(parsed):
    """Texts that a parsed pattern matches: each branch, options left out and taken, no repetition."""
    texts = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = [next((chr(x) for o, x in arg if str(o) == "LITERAL"), "x")]
        elif name == "BRANCH":
            more = [t for branch in arg[1] for t in written(branch)]
        elif name == "SUBPATTERN":
            more = written(arg[-1])
        elif name in ("ASSERT_NOT", "NOT_LITERAL"):
            more = [""]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            more = ([""] if arg[0] == 0 else []) + ([] if arg[0] == 0 and str(arg[2][0][0]) == "IN" else written(arg[2]))
        else:
            assert name == "AT", name
            more = [""]
        texts = [t + m for t in texts for m in more]
    return texts


def test_every_form_of_refusal_holds_a_key_word():
    for keys, form in pair_defects._DECLINES.values():
        texts = written(re._parser.parse(form.pattern, re.I))
        assert [t for t in texts if not any(k in t.lower() for k in keys)] == []
    for answer in ("Lo siento, debo negarme a responder.", "Tengo que negarme a contestar."):
        assert pair_defects.is_refusal(answer)


@pytest.mark.parametrize("answer", ["Clerks can not open it.", "They cannot.", "The clerk role will not open the page.", "Clerks may not share the invoice.", "I see that clerks cannot open it.", "No, clerks can't.", "It cannot be opened."])
def test_what_others_cannot_do_is_a_fact(answer):
    assert defects(Q, answer, None) == []


@pytest.mark.parametrize("answer", ["That topic is off limits for me.", "I can't.", "We would rather not say.", "Can't help with that.", "I'm sorry, I cannot.", "Unfortunately I am not able to discuss this.", "I must respectfully decline."])
def test_what_the_speaker_will_not_do_is_a_refusal(answer):
    assert defects(Q, answer, None)[0] == "refusal"


@pytest.mark.parametrize("answer", ["Ik kan daar helaas geen antwoord op geven.", "Jag kan tyvärr inte svara på den frågan.", "Jeg kan desværre ikke svare på det.", "Nie mogę odpowiedzieć na to pytanie.", "Valitettavasti en voi vastata tähän kysymykseen.", "Я не могу ответить на этот вопрос.", "抱歉，我无法回答这个问题。", "申し訳ありませんが、お答えできません。"])
def test_refusal_in_further_languages(answer):
    assert defects(Q, answer, None)[0] == "refusal"


@pytest.mark.parametrize(
    "answer, name",
    [
        ("Het geheugen hoort bij de module Ledger en wordt elke ochtend opnieuw geladen.", "Dutch"),
        ("Cache hos modulen Ledger, som laddar allt vid start och sparar det sedan till disken.", "Swedish"),
        ("Funkcja jest wywoływana przez moduł, który nie jest w grafie.", "Polish"),
        ("Funcția este apelată din trei module, dar nu și de pe pagină.", "Romanian"),
        ("Siden er ikke låst, og den kan åbnes af alle.", "Danish"),
        ("Bu işlev için bir modül daha var, ama grafikte değil.", "Turkish"),
    ],
)
def test_further_languages(answer, name):
    assert defects(Q, answer, None) == ["language"] and defects(f"{Q} Answer in {name}, please.", answer, None) == []


def test_a_copy_keeps_the_order_of_the_question():
    asked = "Is the page handled by render?"
    assert defects(asked, "The page is handled by render.", None) == []
    assert defects(asked, "Is the page handled by render", None)[0] == "copy" and defects(asked, "is the page handled by", None)[0] == "copy"
    assert "copy" not in defects(asked, "Is the page?", None)


@pytest.mark.parametrize("answer", ["N/A\n" + "-" * 300, "none" + "\n" * 300, "&nbsp;" * 300 + "no answer", "_" * 300 + " none", "n . a" + " ." * 200])
def test_padding_around_nothing(answer):
    assert pair_defects.is_empty(answer)
    assert not pair_defects.is_empty(answer + " but the table orders holds it")
