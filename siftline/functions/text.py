"""Text expressions: templates, ids, prompts, answers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names under which the three standard fields occur.
FIELD_ALIASES = {
    "instruction": ["instruction", "prompt", "question", "query", "input_text", "user", "human"],
    "input": ["input", "context", "additional_context", "system"],
    "output": ["output", "response", "answer", "completion", "assistant", "target", "label"],
}
# Patterns of final answers, in order, then that of a number.
ANSWER_PATTERNS = [r"#### ([-\d,\.]+)", r"\\boxed\{([^}]+)\}", r"The answer is[:\s]*([-\d,\.]+)", r"= ([-\d,\.]+)$"]
NUMBER = r"-?\d+(?:,\d+)*(?:\.\d+)?"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def blank(text: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def render(template: str, fields: dict[str, Column]) -> Column:
    """A ``{field}`` template as one expression."""
    parts = [fields[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*[blank(p) for p in parts]) if parts else F.lit("")


def rendered_text(template: str, fields: dict[str, Column]) -> Column:
    return strip(render(template, fields))


def rendered_content(template: str, fields: dict[str, Column]) -> Column:
    """As ``rendered_text``, with runs of newlines as one."""
    return strip(F.regexp_replace(render(template, fields), "\n+", "\n"))


def content_id(instruction: Column, input_: Column, output: Column, *given: Column) -> Column:
    """The first given id, else 12 hexadecimal digits of the content's MD5."""
    return F.coalesce(*[g.cast("string") for g in given], F.substring(F.md5(F.concat(blank(instruction), blank(input_), blank(output))), 1, 12))


def e5_prefixed(text: Column, model: str) -> Column:
    """Query or passage prefix, by length, for models that want one."""
    return F.when(F.length(text) < 200, F.concat(F.lit("query: "), text)).otherwise(F.concat(F.lit("passage: "), text)) if "e5" in model.lower() else text


def lettered(choices: Column) -> Column:
    """``A. first`` and so on, one a line, of an array."""
    return F.array_join(F.transform(choices, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x)), "\n")


def contains_match(target: Column, response: Column) -> Column:
    """Either text, stripped and lower-cased, is within the other."""
    a, b = F.lower(target), F.lower(response)
    return F.contains(b, F.lower(strip(target))) | F.contains(a, F.lower(strip(response)))


def math_answer(text: Column, patterns: list[str] | None = None) -> Column:
    """Group 1 of the first pattern that occurs, else the last number, else null."""
    clean = strip(text)
    tries = [F.when(clean.rlike(p), F.regexp_extract(clean, p, 1)) for p in patterns or ANSWER_PATTERNS]
    return F.coalesce(*tries, F.try_element_at(F.regexp_extract_all(clean, F.lit(f"({NUMBER})"), F.lit(1)), F.lit(-1)))


def normalised_answer(answer: Column) -> Column:
    """Without commas; whole numbers without a fraction. What is no finite number stays text."""
    plain = strip(F.replace(answer, F.lit(","), F.lit("")))
    number = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))
    return F.when(number.isNotNull() & (F.abs(number) < 1e15) & (number == F.floor(number)), F.floor(number).cast("bigint").cast("string")).otherwise(plain)


def answers_agree(a: Column, b: Column, tolerance: float = 1e-3) -> Column:
    """Equal as text, or as numbers within the tolerance."""
    x, y = normalised_answer(a), normalised_answer(b)
    close = F.abs(x.try_cast("double") - y.try_cast("double")) <= F.lit(tolerance)
    return F.coalesce(x == y, F.lit(False)) | F.coalesce(close, F.lit(False))


def math_error(prediction: Column, reference: Column, tolerance: float = 1e-3) -> Column:
    """0 for a right answer, 1 for a wrong one or none."""
    a, b = math_answer(prediction), math_answer(reference)
    return F.when(a.isNotNull() & b.isNotNull() & answers_agree(a, b, tolerance), F.lit(0.0)).otherwise(F.lit(1.0))


# Dimension, longest input, languages and kind of known embedding models; dollars for a million tokens.
MODELS = [
    ("intfloat/multilingual-e5-large", 1024, 512, True, "sentence-transformers"),
    ("intfloat/multilingual-e5-base", 768, 512, True, "sentence-transformers"),
    ("paraphrase-multilingual-MiniLM-L12-v2", 384, 128, True, "sentence-transformers"),
    ("text-embedding-3-small", 1536, 8191, True, "openai"),
    ("text-embedding-3-large", 3072, 8191, True, "openai"),
]
PRICES = {"text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13, "text-embedding-ada-002": 0.10}


def embedding_cost(model: Column, tokens: Column) -> Column:
    """Estimated dollars; unknown models cost as much as the smallest."""
    price = F.coalesce(*[F.when(model == m, F.lit(p)) for m, p in PRICES.items()], F.lit(0.02))
    return tokens / F.lit(1_000_000.0) * price


def training_prompt(task: str, instruction: Column, input_: Column) -> Column:
    """The prompt of a sample: multiple choice (``mmlu``), reasoning (``bbh``), or plain."""
    instruction, input_ = blank(instruction), blank(input_)
    parsed = F.from_json(input_, "array<string>")
    if task == "mmlu":
        choices = F.when(F.trim(input_).startswith("[") & parsed.isNotNull(), lettered(parsed)).otherwise(input_)
        body = F.when(input_ == "", F.concat(F.lit("Question: "), instruction)).otherwise(F.concat(F.lit("Question: "), instruction, F.lit("\n\n"), choices))
    elif task == "bbh":
        body = F.concat(F.lit("Task: "), instruction, F.lit("\n\nLet's think step by step."))
    else:
        body = F.when(input_ == "", instruction).otherwise(F.concat(instruction, F.lit("\n\n"), input_))
    return F.concat(body, F.lit("\n\nAnswer:"))
