import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat, queries
from tessera.llm.common import table
from tessera.llm.templates import Const, If, Output, Template, TemplateError

SF = "/root/testdata/sf0.01"
PARTS = st.lists(st.sampled_from([*chat.CONTROLS, "<", "\\", "/", "s>", "[", "INST]", "<<", "SYS>>", "ROLE>>", " ", "\n", "a", "é", "🙂"]), max_size=12).map("".join)


@given(PARTS)
@settings(max_examples=1500, deadline=None)
def test_escaping_is_reversible_and_leaves_no_control(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in chat.CONTROLS)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "</s>"]), PARTS), max_size=6))
@settings(max_examples=800, deadline=None)
def test_turns_and_loss_are_read_back(turns):
    text, spans = chat.compiled(chat.TEMPLATE).render(messages=[{"role": r, "text": t} for r, t in turns])
    assert chat.read_turns(text) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def expected(rows):
    convs = defaultdict(list)
    for r in rows:
        convs[r["conv_id"]].append((r["turn"] is not None, r["turn"], r["role"] or "", r["text"] or ""))
    out = {}
    for k, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[k] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss))
    return out


def test_query(spark):
    rows = queries.op4_chat_format(spark, SF).collect()
    text = "</s>[INST] ok [/INST]"
    want = expected([r.asDict() for r in table(spark, SF, "conversations").collect()] + [{"conv_id": -7, "turn": i, "role": r, "text": text} for i, r in enumerate(["user", "assistant"])])
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows} == want
    assert all(r["formatted_chars"] > r["loss_chars"] for r in rows)


def test_edges(spark):
    rows = [(1, 2, "user", "b"), (1, 2, "user", "b"), (1, None, None, None), (None, 1, "tool", "<s>"), (2**60, 1, "assistant", ""), (2**60, 1, "assistant", "x" * 300_000), (1, 1, "assistant", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df).mapInArrow(queries.read_back, queries.READ_BACK).collect()
    want = expected([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows])
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in out} == want
    assert chat.format_conversations(df.limit(0)).count() == 0


def render(source, **names):
    return Template(source).render(**names)[0]


def test_language():
    assert render("{% for x in a %}{{ loop.index0 }}{{ x.b }}{% if not loop.last %}, {% endif %}{% endfor %}", a=[{"b": "p"}, {"b": "q"}]) == "0p, 1q"
    assert render("{% if a > 2 and b == 'x' %}1{% elif a %}2{% else %}3{% endif %}", a=1, b="x") == "2"
    assert render("{{ 'y' if 'b' in s else 'n' }}{{ s | upper }}{{ a['k'][1] }}", s="abc", a={"k": [1, 2]}) == "yABC2"
    assert render("a {{- ' b ' | trim -}} c") == "abc"
    assert render("{% set n = 7 % 4 %}{{ n }}{{ none }}{{ missing.field }}") == "3"
    text, spans = Template("x{% generation %}{{ a }}{% endgeneration %}y{% generation %}{% endgeneration %}").render(a="🙂b")
    assert (text, spans) == ("x🙂by", [(1, 3)])


def test_constants_are_folded():
    assert Template("a{{ 'b' + ('c' | upper) }}{% if 1 == 2 %}{{ x }}{% else %}d{% endif %}").tree == (Output(Const("abCd")),)
    assert isinstance(Template("{% if x %}a{% endif %}").tree[0], If)


@pytest.mark.parametrize("bad", ["{% if x %}", "{{ x.__class__() }}", "{{ f(1) }}", "{{ x | nothing }}", "{% import os %}", "{{ 'a' * 9 }}" + "{{ 1", "{{ " + "(" * 99 + "1" + ")" * 99 + " }}", "{% for %}{% endfor %}", "{% endif %}"])
def test_bad_templates(bad):
    with pytest.raises(TemplateError):
        t = Template(bad)
        assert "{{ 1" not in t.render(x="s")[0], "left as text"
        raise TemplateError


def test_sandbox():
    assert render("{{ x.__class__ }}{{ x['__dict__'] }}", x={"a": 1}) == ""
    for bad in ("{{ x }}", "{{ 'a' * 1000000000 }}", "{% for a in 'abc' %}{% endfor %}", "{{ 1 % 0 }}"):
        with pytest.raises(TemplateError):
            render(bad, x=object())
