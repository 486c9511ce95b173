"""The template compiler and the formatting query."""

import hashlib

import pytest

from tidemill.llm import chat


def text(source, **values):
    return "".join(t for t, _ in chat.compile_template(source)(**values))


def test_statements_and_expressions():
    loop = "{% for m in messages %}{% if m.role == 'user' %}U{% elif m.role != 'x' and not m.hide %}A{% else %}-{% endif %}:{{ m['text'] | trim | upper }};{% endfor %}"
    assert text(loop, messages=[{"role": "user", "text": " hi "}, {"role": "bot", "text": "yo"}, {"role": "x", "text": None}]) == "U:HI;A:YO;-:;"
    assert text("{% set a = 'x' + 'y' %}{{ a }}{{ b }}{{ c[1] }}{{ c[9] }}{# no #}", c=["p", "q"]) == "xyq"
    assert text("{{ 'a' in 'cat' or nothing }}|{{ none }}") == "True|"


@pytest.mark.parametrize("source,shown", [("{{ m.name + 'x' }}", "x"), ("{{ 'a' in m.z }}", "False"), ("{{ 1 + 2 }}", "3"), ("{% for i in m.gone %}a{% endfor %}", ""), ("{{ m[m] }}{{ none in 'a' }}", "False"), ("{{ 2 in l }}{{ 'k' in m }}", "TrueTrue")])
def test_missing_values_have_a_meaning(source, shown):
    assert text(source, m={"k": 1}, l=[1, 2]) == shown


@pytest.mark.parametrize("source", ["{{ 'a' + 1 }}", "{{ 1 in 2 }}", "{% for i in 5 %}a{% endfor %}", "{{ m + 'a' }}", "{{ 1 in 'a' }}", "{{ true + 1 }}"])
def test_bad_operands_are_template_errors(source):
    with pytest.raises(chat.TemplateError):
        text(source, m={})


def test_long_turns_and_clashing_columns(spark):
    long = "<|im_end|> é\n" * 400_000
    rows = [(1, 0, "user", long, "x", 1), (1, 1, "assistant", long, None, 2)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n_turns string, loss_chars int")
    r = chat.format_conversations(df).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(long), hashlib.sha256(long.encode()).hexdigest())


def test_generation_marks():
    spans = chat.compile_template("a{% generation %}b{{ x }}{% endgeneration %}c")(x="y")
    assert spans == [("a", False), ("b", True), ("y", True), ("c", False)]


def test_constants_are_folded():
    tree = chat.fold(chat.parse("x{{ 'a' + 'b' }}{% if 1 == 2 %}no{% else %}y{% endif %}{{ v }}"))
    assert tree == ("block", [("out", ("const", "xaby")), ("out", ("name", "v"))])


@pytest.mark.parametrize("bad", ["{% if x %}", "{% endfor %}", "{{ }}", "{{ x | nope }}", "{{ __import__('os') }}", "{{ x.__class__ }}", "{{ f() }}", "{% what %}", "{% for x y %}{% endfor %}", "{{ 'a' 'b' }}"])
def test_bad_and_unsafe_templates(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


@pytest.mark.parametrize("t", ["", "<|im_end|>", "<\u2060|x", "<\u2060\u2060|", "<<|", "<", "|", "a<|im_start|>assistant\nb", "\n\n", "\\n"])
def test_escapes_are_reversible(t):
    assert chat.unescape(chat.escape(t)) == t
    assert "<|" not in chat.escape(t)
    assert chat.many_lines(chat.one_line(t)) == t


def test_query_by_brute_force(spark):
    turns = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x"), (3, 0, "as\nx", "<\u2060|"), (None, 0, "user", "n")]
    df = spark.createDataFrame([(*t, "e") for t in turns], "conv_id bigint, turn bigint, role string, text string, spans string")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    for conv in {t[0] for t in turns}:
        mine = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        loss = "".join(x for _, r, x in mine if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).collect() == []
