"""The template compiler by examples and against plain evaluation; chats against brute force."""

import hashlib
import random

import duckdb
import pytest
from test_secrets_warc_vectors import SF

from lodestone.llm.chat import CHAT, CONTROLS, chat_template, escaped, formatted, read_back, turns, unescaped
from lodestone.llm.queries import ORACLE_SQL, QUERIES
from lodestone.llm.templates import Const, For, Out, Template, TemplateError

MESSAGES = [{"role": "system", "text": "s"}, {"role": "user", "text": "u1"}, {"role": "assistant", "text": "a1"}, {"role": "user", "text": "u2"}, {"role": "assistant", "text": "a2"}]


def shown(source, messages=MESSAGES, **constants):
    out = Template(source, constants).render(messages)
    return "".join(out.parts)


@pytest.mark.parametrize(
    "source, want",
    [
        ("a{# no {{ x }} #}b", "ab"),
        ("{{ 1 + 2 * 3 - 4 // 2 }} {{ -7 % 3 }} {{ 'a' + \"b\" ~ 3 }}", "5 2 ab3"),
        ("{{ 'q\\n\\'}}' }}", "q\n'}}"),
        ("{{ messages | length }}{{ messages[0].role }}{{ messages[-1]['text'] }}{{ messages[9].text }}{{ messages[0].nothing }}", "5systema2"),
        ("{% for m in messages %}{{ loop.index }}{% if loop.first %}F{% endif %}{% if loop.last %}L{% endif %}{{ m.role[0] }} {% endfor %}", "1Fs 2u 3a 4u 5La "),
        ("{% for m in messages %}{% if m.role == 'user' and 'u2' in m.text %}x{% elif m.role != 'system' or false %}y{% else %}z{% endif %}{% endfor %}", "zyyxy"),
        ("{% set x = 1 %}{% for m in messages %}{% set x = x + 1 %}{{ x }}{% endfor %}{{ x }}", "222221"),
        ("{% if true %}{% set y = 'in' %}{% endif %}{{ y }}", "in"),
        ("{% if messages %}{% set y = 'in' %}{% endif %}{{ y }}", "in"),
        ("{{ ' x ' | trim | upper }}{{ none | default('d') }}{{ 'aXa' | replace('a', 'b') }}{{ 'a' if 1 > 2 else 'b' }}{{ 'c' if false }}", "XdbXbb"),
        ("{{ 'a' in 'cat' }} {{ 3 not in messages }} {{ messages is defined }} {{ messages[0].zip is defined }} {{ none is none }} {{ 'x' is not string }}", "true true true false true false"),
        ("  {%- if true -%}  \n a  {%- endif -%}  b ", "ab "),
        ("{{ bos }}|{{ nested.deep[1] }}", "<s>|2"),
        ("{% for m in [] %}{% endfor %}", None),
    ],
)
def test_language(source, want):
    if want is None:
        with pytest.raises(TemplateError):
            Template(source)
    else:
        assert shown(source, bos="<s>", nested={"deep": [1, 2]}) == want


@pytest.mark.parametrize("source", ["{{ x }}", "{{ 'a' | nope }}", "{{ messages.append(1) }}", "{% for m in messages %}", "{{ 1 +", "{% endif %}", "{{ 'a' * 3 }}", "{{ 1 // 0 }}", "{% zap %}", "{{ 1 2 }}", "{% for m in 3 %}{{ m }}{% endfor %}", "{% generation %}{% if true %}{% generation %}{% endgeneration %}a{% endif %}{% endgeneration %}", "{% if true %}{% else %}{% else %}{% endif %}", "{{ 1 < 'a' }}"])
def test_faulty_templates(source):
    with pytest.raises(TemplateError):
        shown(source + "x" if "for" not in source else source)
        Template(source).render(MESSAGES)


def test_sandbox():
    assert shown("{{ messages.__class__ }}{{ messages[0].keys }}{{ 'a'.upper }}{{ messages[0].role.__len__ }}") == ""


def test_constants_are_folded():
    t = Template("{% set sep = '|' %}{% if mode == 'long' %}{{ 'A' ~ sep }}{% else %}{{ messages }}{% endif %}{{ 1 + 2 }}", {"mode": "long"})
    assert t.body == (Out(Const("A|3")),)
    t = chat_template(CHAT)
    assert t.turnwise and isinstance(t.body[0], For) and len(t.body) == 1
    assert chat_template("{% set s = '!' %}{% for m in messages %}{{ m.text ~ s }}{% endfor %}").turnwise
    for other in ("{{ bos }}" + CHAT, CHAT.replace("{{ eos }}", "{{ loop.index }}"), "{% for m in messages %}{{ messages[0].text }}{% endfor %}"):
        assert not chat_template(other).turnwise


def test_folding_changes_nothing():
    rng = random.Random(3)
    names = {"a": 3, "b": "x", "c": None, "d": ["p", "q"], "e": {"k": 5}}

    def expression(depth=0):
        if depth > 3 or rng.random() < 0.3:
            return rng.choice(["a", "b", "c", "d[0]", "e.k", "e.z", "2", "'t'", "true", "none"])
        x, y, z = (expression(depth + 1) for _ in range(3))
        return rng.choice([f"({x} ~ {y})", f"({x} == {y})", f"({x} and {y})", f"({x} or {y})", f"(not {x})", f"({x} if {y} else {z})", f"({x} | default({y}))", f"({x} | length)", f"({x} in {y})", f"({x} | string | upper)"])

    for _ in range(300):
        e = expression()
        # Known when compiled, and known only when rendered.
        late = "{% for m in messages %}" + "".join(f"{{% set {n} = m.{n} %}}" for n in names) + "{{ " + e + " }}{% endfor %}"
        assert shown("{{ " + e + " }}", **names) == shown(late, [names])


def test_escapes_are_reversible():
    rng = random.Random(4)
    alphabet = [*CONTROLS, "\\", "[", "]", "<", ">", "/", "s", "I", "\\\\", "[\\INST]", "é", "\n"]
    for _ in range(3000):
        said = [(rng.choice(["user", "assistant", "system", "", "tool\n", "</s>", "[/ROLE]"]), "".join(rng.choices(alphabet, k=rng.randrange(7)))) for _ in range(rng.randrange(4))]
        assert all(unescaped(escaped(x)) == x and not any(c in escaped(x) for c in CONTROLS) for _, x in said)
        out = chat_template().render([{"role": r, "text": x} for r, x in said])
        text = "".join(out.parts)
        assert list(turns(text)) == said
        assert [unescaped(text[a:b]) for a, b in out.spans] == [x for r, x in said if r == "assistant" and x]


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = []
    for conv, said in by.items():
        said = [(r, x) for _, r, x in sorted(said, key=lambda s: (s[0], s[1].encode(), s[2].encode()))]
        learnt = "".join(x for r, x in said if r == "assistant")
        chars = sum(len(escaped(x)) + {"assistant": 4, "user": 13, "system": 11}.get(r, len(escaped(r)) + 17) for r, x in said)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(said), digest("".join(f"{r}\n{x}\n" for r, x in said)), len(learnt), digest(learnt), chars))
    return sorted(out, key=repr)


def got(parts):
    return sorted((tuple(r) for r in read_back(parts).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()), key=repr)


SCHEMA = "part int, text string, conv_id long, turn long, role string, whole string"


def test_odd_conversations_and_a_hot_one(spark):
    rng = random.Random(5)
    rows = [(7, i, ("user", "assistant")[i % 2], "".join(rng.choices(["x", "</s>", "é", "\\"], k=5))) for i in range(2000)]  # a third of all rows
    rows += [(i, j, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice([None, "", "[INST]", "word " * 20])) for i in range(1000) for j in range(4)]
    rows += [(None, 1, "user", "n"), (None, None, "assistant", "m"), (8, 1, "user", "same"), (8, 1, "user", "same"), (5000, None, None, None), (6000, 1, "assistant", "y" * 3_000_000), (6000, 2, "user", "z" * 1_500_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(1, t, c, n, r, "w") for c, n, r, t in rows], SCHEMA).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = formatted(df)
        assert got(parts) == expected(rows)
        by = {}
        for r in parts.orderBy("part").collect():
            by.setdefault(r.conv_id, []).append(r)
        assert len(by[7]) > 1  # the hot one lies in several tasks
        assert len(by[6000]) == 2 and [len(r.text) for r in by[6000]] == [3_000_004, 1_500_013]
        assert sum(r.n_turns for r in by[7]) == 2004 and all(len(p) == 1 for p in by.values() if p[0].whole)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_templates_of_whole_conversations(spark):
    source = "{{ bos }}{% for m in messages %}{{ loop.index }}/{{ messages | length }}:{% if m.role == 'assistant' %}{% generation %}{{ m.text | guard }}{% endgeneration %}{% else %}{{ m.text | guard }}{% endif %}{% if not loop.last %}, {% endif %}{% endfor %}"
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c}-{t}") for c in range(30) for t in range(c % 5 + 1)]
    out = {r.conv_id: r for r in formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3), source).collect()}
    assert len(out) == 30 and all(r.whole for r in out.values())
    assert out[3].text == "<s>1/4:3-0, 2/4:3-1, 3/4:3-2, 4/4:3-3" and [out[3].text[s.start : s.end] for s in out[3].spans] == ["3-1", "3-3"]


def test_no_rows(spark):
    assert got(formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))) == []


def test_query_matches_sql(spark):
    rows = QUERIES["op11_chat_format"](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    want = con.execute(ORACLE_SQL["op11_chat_format"])
    columns = [d[0] for d in want.description]
    assert sorted(rows.columns) == sorted(columns)
    rows = rows.select(columns).collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall())
    own = next(r for r in rows if r.conv_id == -1)
    text = "</s>[INST] ok [/INST]"
    assert own.n_turns == 2 and own.loss_chars == len(text) and own.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
