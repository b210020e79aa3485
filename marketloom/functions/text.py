"""Prompts, model-written JSON and rule-based judges as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ("strong_down", "mild_down", "neutral", "mild_up", "strong_up")
RATIONALE = "news_rationale array<string>, technical_rationale array<string>, conflict_resolution string, forecast_distribution struct<strong_down:double,mild_down:double,neutral:double,mild_up:double,strong_up:double>, action string, risk_note string"


def fixed(x: Column, digits: int) -> Column:
    """x with so many decimals, rounded as printf does: from the double's exact value, half to even. format_string rounds its
    shortest decimals half up, so that 0.815 and 0.125 would be 0.82 and 0.13 (here 0.81 and 0.12). Null stays null."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * digits))


def render(template: str, **values: Column) -> Column:
    """Fills {name} in a template; null values are empty."""
    out = F.lit(template)
    for name, v in values.items():
        out = F.replace(out, F.lit("{%s}" % name), F.coalesce(v.cast("string"), F.lit("")))
    return out


def render_chat(messages: Column) -> Column:
    """Turns as "Role: content" lines with an open assistant turn."""
    line = lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), F.coalesce(m["content"], F.lit("")))
    return F.concat(F.array_join(F.transform(messages, line), "\n"), F.lit("\nAssistant:"))


def chat_template(messages: Column, before: dict[str, str], after: str = "\n", opening: str | None = None) -> Column:
    """Turns end to end, each as its role's mark, its content and `after`; then `opening`, which an answer continues.

    A role without a mark has none of its own: its name stands for it, in lines of their own. Null contents are empty.
    """
    marks = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    turn = lambda m: F.concat(F.coalesce(F.try_element_at(marks, m["role"]), F.concat(m["role"], F.lit("\n"))), F.coalesce(m["content"], F.lit("")), F.lit(after))
    return F.concat(F.array_join(F.transform(messages, turn), ""), F.lit(opening or ""))


#: The marks of two common chat formats.
CHATML = {r: f"<|im_start|>{r}\n" for r in ("system", "user", "assistant")}
CHATML_END, CHATML_OPENING = "<|im_end|>\n", "<|im_start|>assistant\n"


def completion_of(whole: Column, prompt: Column) -> Column:
    """What a rendered conversation has beyond its rendered prompt; null where it does not begin with it."""
    return F.when(whole.startswith(prompt), F.substring(whole, F.length(prompt) + 1, F.length(whole)))


#: Fixed value: what a masked column holds.
MASKED = "None"


def extract_json(text: Column) -> Column:
    """A fenced block that holds an object, else from the first { to the last }, else all; null if it doesn't parse."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    raw = F.when(fenced != "", fenced).when(braces != "", braces).otherwise(text)
    return F.when(F.get_json_object(raw, "$").isNotNull(), F.trim(raw))


def normalize_action(x: Column) -> Column:
    a = F.lower(F.trim(x))
    return F.when(a == "buy", "long").when(a == "sell", "short").when(a.isin("long", "short", "hold"), a).otherwise("hold")


def probs(r: Column) -> Column:
    return F.array(*[F.coalesce(r["forecast_distribution"][c], F.lit(0.0)) for c in CLASSES])


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


ACTIONS = ("long", "short", "hold")


def repaired_action(r: Column) -> Column:
    return F.when(r["action"].isin(*ACTIONS), r["action"]).otherwise("hold")


def repaired_probs(r: Column) -> Column:
    """The distribution, overwritten where it doesn't sum to one or the action's side is not the likelier one."""
    p, action = probs(r), repaired_action(r)
    up, down = p[3] + p[4], p[0] + p[1]
    bad = F.abs(total(p) - 1) > 0.05
    fixed = lambda *v: F.array(*map(F.lit, v))
    return (
        F.when((action == "long") & (bad | (up <= down)), fixed(0.0, 0.0, 0.0, 0.4, 0.6))
        .when((action == "short") & (bad | (down <= up)), fixed(0.6, 0.4, 0.0, 0.0, 0.0))
        .when((action == "hold") & (bad | (p[2] < 0.4)), fixed(0.0, 0.0, 1.0, 0.0, 0.0))
        .otherwise(p)
    )


#: What stands for missing parts of a rationale.
NO_RATIONALE, NO_TEXT = "No rationale provided", "None"


def repaired_rationale(r: Column) -> Column:
    """The rationale with action, distribution, lists and texts repaired; null stays null."""
    p = repaired_probs(r)
    items = lambda c: F.when(F.coalesce(F.size(r[c]), F.lit(0)) > 0, r[c]).otherwise(F.array(F.lit(NO_RATIONALE))).alias(c)
    note = lambda c: F.coalesce(r[c], F.lit(NO_TEXT)).alias(c)
    dist = F.struct(*[p[i].alias(c) for i, c in enumerate(CLASSES)]).alias("forecast_distribution")
    return F.when(r.isNotNull(), F.struct(items("news_rationale"), items("technical_rationale"), note("conflict_resolution"), dist, repaired_action(r).alias("action"), note("risk_note")))


def validation_error(r: Column) -> Column:
    """The first failing rule, null for a valid rationale."""
    p, action = probs(r), r["action"]
    fields = [r[c] for c in ("news_rationale", "technical_rationale", "conflict_resolution", "risk_note")] + [r["forecast_distribution"][c] for c in CLASSES]
    missing = F.lit(False)
    for f in fields:
        missing = missing | f.isNull()
    return (
        F.when(r.isNull(), "parse")
        .when(missing, "missing_field")
        .when(F.exists(p, lambda x: (x < 0) | (x > 1)), "probability_range")
        .when((total(p) < 0.95) | (total(p) > 1.05), "probability_sum")
        .when(~F.coalesce(action, F.lit("")).isin(*ACTIONS), "action")
        .when((action == "long") & (p[0] + p[1] > 0.6), "long_against_down")
        .when((action == "short") & (p[3] + p[4] > 0.6), "short_against_up")
    )


def parse_number(text: Column, name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.regexp_extract(text, rf'(?i)"?{name}"?\s*[:=]\s*"?([0-9]*\.?[0-9]+)', 1).try_cast("double"), F.lit(default))


def parse_distribution(text: Column) -> Column:
    """Five class probabilities by their quoted names, neutral 1 and the others 0 where a name is missing, renormalised;
    all neutral if they sum to zero. A number that can't be read ends the reading: it and those after it keep their defaults."""
    raw = [F.regexp_extract(text, f'"{c}"\\s*:\\s*([0-9.]+)', 1) for c in CLASSES]
    values, broken = [], F.lit(False)
    for c, v in zip(CLASSES, raw, strict=True):
        broken = broken | ((v != "") & v.try_cast("double").isNull())
        values.append(F.when(broken | (v == ""), 1.0 if c == "neutral" else 0.0).otherwise(v.try_cast("double")))
    p = F.coalesce(F.array(*values), F.array(*map(F.lit, (0.0, 0.0, 1.0, 0.0, 0.0))))
    t = total(p)
    return F.when(t > 0, F.transform(p, lambda x: x / t)).otherwise(F.array(*map(F.lit, (0.0, 0.0, 1.0, 0.0, 0.0))))


#: Fixed value: what stands for a sample without numbers.
NO_NUMBERS = "No technical features"


def raw_number_tokens(cols: list[str]) -> Column:
    """"name: value" of the columns that aren't null, four decimals. Samples without a row of numbers get NO_NUMBERS after a left join."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), fixed(F.col(c), 4))) for c in cols])), ", ")


def replace_block(text: Column, start: str, end: str, new: Column) -> Column:
    """Replaces what stands between two markers; the text itself where a marker is missing."""
    at = F.instr(text, start)
    rest = F.substring(text, at + len(start), F.length(text))
    stop = F.instr(rest, end)
    return F.when((at > 0) & (stop > 0), F.concat(F.substring(text, F.lit(1), at + len(start) - 1), new, F.substring(rest, stop, F.length(rest)))).otherwise(text)


#: Fixed value: a summary that matches from its start says nothing.
UNINFORMATIVE = r".*[nN]o.*information.*|.*[nN]o.*facts.*|.*[nN]o.*mention.*|.*[nN]o.*tweets.*|.*do not contain.*"


def is_informative(x: Column) -> Column:
    return ~x.rlike(rf"^(?:{UNINFORMATIVE})")


def remove_between(x: Column, start: str, end: str, joint: str = "\n\n") -> Column:
    """What stands before the first start and between the first end and the next, trimmed and joined: prompts without their examples."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.concat(strip(F.substring_index(x, start, 1)), F.lit(joint), strip(F.try_element_at(F.split(x, "\\Q" + end + "\\E"), F.lit(2))))


def after_last(x: Column, marker: str) -> Column:
    return F.substring_index(x, marker, -1)


def first_word(x: Column) -> Column:
    return F.regexp_extract(F.trim(x), r"^(\w+)", 1)


#: The prompt of instruction tuning, with and without an input; its lines are indented.
WITH_INPUT = "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request."
WITHOUT_INPUT = "Below is an instruction that describes a task. Write a response that appropriately completes the request."
INDENT = "    "


def instruction(instr: Column, inp: Column, out: Column) -> Column:
    part = lambda name, x: F.concat(F.lit(f"\n\n{INDENT}### {name}:\n{INDENT}"), F.coalesce(x, F.lit("")))
    given = F.coalesce(inp, F.lit("")) != ""
    return F.concat(F.when(given, WITH_INPUT).otherwise(WITHOUT_INPUT), part("Instruction", instr), F.when(given, part("Input", inp)).otherwise(""), part("Response", out))


def question_answer(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\nAnswer: "), answer)


def mention_index(tokens: Column, ticker: str | Column) -> Column:
    """0-based place of the lower-cased ticker, else of the first token after the first `$` that contains it, else the last."""
    t = F.lower(ticker if isinstance(ticker, Column) else F.lit(ticker))
    whole, dollar = F.array_position(tokens, t), F.array_position(tokens, "$")
    places = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)))
    after = F.filter(places, lambda i: (i > dollar) & F.try_element_at(tokens, i.cast("int")).contains(t))
    return F.when(whole > 0, whole - 1).when((dollar > 0) & (F.size(after) > 0), F.get(after, F.lit(0)) - 1).otherwise(F.size(tokens) - 1).cast("int")


def technical_grounding(tokens: Column, rationale: Column) -> Column:
    """Share of token names that the rationale mentions; an empty rationale 0, else no tokens 1."""
    names = F.transform(tokens, lambda t: F.upper(F.regexp_extract(t, r"\[?([A-Za-z0-9_]+)", 1)))
    return _mentioned(names, rationale)


def _mentioned(names: Column, rationale: Column) -> Column:
    hit = F.size(F.filter(names, lambda n: F.upper(rationale).contains(n)))
    return F.when(F.coalesce(rationale, F.lit("")) == "", 0.0).when(F.coalesce(F.size(names), F.lit(0)) <= 0, 1.0).otherwise(hit / F.size(names))


def technical_grounding_text(tokens: Column, rationale: Column) -> Column:
    """The same for a text of tokens: bare names in brackets, or where there are none, what stands between commas."""
    bare = F.regexp_extract_all(tokens, F.lit(r"(\[[A-Z0-9_]+\])"), F.lit(1))
    listed = F.filter(F.transform(F.split(tokens, ","), lambda t: F.trim(t)), lambda t: t != "")
    names = F.transform(F.when(F.size(bare) > 0, bare).otherwise(listed), lambda t: F.upper(F.trim(F.translate(t, "[]", ""))))
    return _mentioned(F.when(F.trim(tokens) != "", names), rationale)


def utility(action: Column, r: Column, cost: float = 0.001) -> Column:
    """The return of an action (any case, white space around it) after costs, on a logistic scale; any other action is worth 0.5."""
    act = F.lower(F.regexp_replace(action, r"^\s+|\s+$", ""))
    payoff = F.when(act == "long", r - cost).when(act == "short", -r - cost).otherwise(0.0)
    return 1 / (1 + F.exp(-50 * payoff))


def argmax_label(p: Column, names: tuple[str, ...]) -> Column:
    """The first of the largest."""
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(p, F.array_max(p)).cast("int"))


def softmax(x: Column) -> Column:
    """Shifted by the largest value, which with the sum is worked out once for an array, not once for a value."""
    one = F.transform(F.array(x), lambda a: F.transform(F.array(F.array_max(a)), lambda top: F.transform(a, lambda v: F.exp(v - top)))[0])
    return F.transform(one, lambda e: F.transform(F.array(total(e)), lambda t: F.transform(e, lambda v: v / t))[0])[0]


def entropy(p: Column, eps: float = 1e-9) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.ln(x + eps))


#: Regime tokens, and the one that is added where there is none.
HIGH_REGIME, LOW_REGIME, ADDED_REGIME = "[HIGH_VOLATILITY_REGIME", "[LOW_VOLATILITY_REGIME", " [HIGH_VOLATILITY_REGIME: vol20=9.99, strength=strong]"


def flip_regime(tokens: Column) -> Column:
    """Volatility regime tokens of a text turned round; a high one is added where there is none."""
    swap = lambda a, b: F.replace(tokens, F.lit(a), F.lit(b))
    return F.when(tokens.contains(HIGH_REGIME), swap(HIGH_REGIME, LOW_REGIME)).when(tokens.contains(LOW_REGIME), swap(LOW_REGIME, HIGH_REGIME)).otherwise(F.concat(tokens, F.lit(ADDED_REGIME)))


def word_count(x: Column) -> Column:
    return F.size(F.split(F.trim(x), r"\s+"))


def valid_items(text: Column, keys: tuple[str, ...]) -> Column:
    """How many objects of a model-written JSON list, fenced or not, hold all keys; 0 if it doesn't parse."""
    bare = F.trim(F.regexp_replace(text, r"```(?:json)?", ""))
    items = F.from_json(bare, "array<map<string,string>>")
    has = lambda m: F.forall(F.array(*map(F.lit, keys)), lambda k: F.array_contains(F.map_keys(m), k))
    return F.when(items.isNull(), 0).otherwise(F.size(F.filter(items, lambda m: m.isNotNull() & has(m))))


def vocabulary_ids(tokens: Column, vocab: dict[str, int], most: int) -> Column:
    """Ids of the first `most` tokens; unknown ones are 0. For vocabularies small enough to be literals; `index_tokens` joins a table."""
    pairs = [F.lit(x) for w, i in vocab.items() for x in (w, i)]
    table = F.create_map(*pairs)
    return F.transform(F.slice(tokens, 1, most), lambda w: F.coalesce(table[w], F.lit(0)))


def strip_prompt(generated: Column, prompt: Column) -> Column:
    return F.replace(generated, prompt, F.lit(""))


def exact_match(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)
