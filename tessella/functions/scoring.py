"""Answer extraction and grading.

Scorers that regular expressions can express are columns. Balanced braces and LaTeX normal forms need a loop over
characters: these are plain functions, applied in Arrow batches. No answer text is ever evaluated as code; equality of
expressions is decided on exact fractions, and what can't be decided is "not equal".
"""

from __future__ import annotations

import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from tessella.functions import algebra
from tessella.functions.text import strip

TAIL = 300


def gsm8k_strict(text: Column) -> Column:
    """Number after the last `####` of the last 300 characters, without commas and dollar signs."""
    found = F.regexp_extract_all(F.right(text, F.lit(TAIL)), F.lit(r"#### (-?[0-9.,]+)"), F.lit(1))
    return F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"[,$]", "")


def gsm8k_flexible(text: Column) -> Column:
    """Last number of the last 300 characters that is more than a dot."""
    found = F.filter(F.regexp_extract_all(F.right(text, F.lit(TAIL)), F.lit(r"(-?[0-9.,]+)"), F.lit(1)), lambda x: ~x.isin("", "."))
    return F.try_element_at(found, F.lit(-1))


def exact_score(answer: Column, truth: Column, score: float = 1.0, format_score: float = 0.0) -> Column:
    return F.when(answer.isNull(), 0.0).when(answer == truth, score).otherwise(format_score)


#: Replacements of the final-answer normal form, in this order (fixed values).
SUBSTITUTIONS = (
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), (r"\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
)
#: Expressions that are taken out of it (fixed values).
REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges",
    "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", r"\mathrm{th}", r"^\circ", r"^{\circ}", r"\;", r",\!", "{,}", '"', "\\dots",
)


#: Patterns that are then rewritten, in this order: a dollar span, three text commands and a box to their content, bare
#: fractions and roots with braces, dollar signs out (fixed values).
PATTERNS = (
    (r"(.*?)\$(.*?)\$(.*)", r"\$$2\$"), (r"\\text\{(.*?)\}", "$1"), (r"\\textbf\{(.*?)\}", "$1"), (r"\\overline\{(.*?)\}", "$1"), (r"\\boxed\{(.*)\}", "$1"),
    (r"(frac)([^{])(.)", r"frac{$2}{$3}"), (r"(sqrt)([^{])", r"sqrt{$2}"), (r"\$", ""),
)


def normalize_final_answer(text: Column) -> Column:
    """Normal form of a final answer: what follows the last '=', words and units out, bare fractions and roots braced, commas out."""
    t = F.substring_index(text, "=", -1)
    for a, b in SUBSTITUTIONS:
        t = F.replace(t, F.lit(a), F.lit(b))
    for x in REMOVED:
        t = F.replace(t, F.lit(x), F.lit(""))
    for pattern, put in PATTERNS:
        t = F.regexp_replace(t, pattern, put)
    t = F.when(F.regexp_replace(t, ",", "").rlike(r"^[0-9]+$"), F.regexp_replace(t, ",", "")).otherwise(t)
    return strip(t)


def last_answer_line(text: Column) -> Column:
    """What follows the last `Answer:` in the last 300 characters; `[INVALID]` if there is none."""
    found = F.regexp_extract_all(F.right(text, F.lit(TAIL)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("[INVALID]"))


def minerva_score(text: Column, truth: Column) -> Column:
    """1 if the normal forms agree, else -1."""
    return F.when(normalize_final_answer(last_answer_line(text)) == normalize_final_answer(truth), 1.0).otherwise(-1.0)


def qa_normalize(text: Column) -> Column:
    """Lower case; punctuation out; articles out; spaces collapsed."""
    t = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return strip(F.regexp_replace(F.regexp_replace(t, r"\b(a|an|the)\b", " "), r"\s+", " "))


def qa_answer(text: Column) -> Column:
    """Body of the last <answer> element."""
    return strip(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1)))


def _qa(text: Column, hit: Column) -> Column:
    many = (F.regexp_count(text, F.lit("<answer>")) > 10) | (F.regexp_count(text, F.lit("</answer>")) > 10)
    return F.when(F.coalesce(hit, F.lit(False)), F.when(many, 0.25).otherwise(1.0)).otherwise(0.0)


def qa_exact(text: Column, truth: Column) -> Column:
    return _qa(text, qa_normalize(qa_answer(text)) == qa_normalize(truth))


def qa_contains(text: Column, truth: Column) -> Column:
    return _qa(text, qa_normalize(qa_answer(text)).contains(qa_normalize(truth)))


def format_reward(text: Column) -> Column:
    """1 if the whole text is a think element, then anything with a box in it."""
    return F.when(text.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"), 1.0).otherwise(0.0)


def code_block(text: Column) -> Column:
    """Body of the last fenced python block, or of the last fenced block."""
    last = lambda p: F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(-1))
    return F.coalesce(last(r"(?s)```python\n(.*?)```"), last(r"(?s)```[a-z]*\n(.*?)```"))


def last_boxed(text: str | None) -> str | None:
    """Content of the last \\boxed{..} or \\fbox{..} with balanced braces, or of `\\boxed x`; None without one."""
    if not text:
        return None
    at = max(text.rfind("\\boxed"), text.rfind("\\fbox"))
    if at < 0:
        return None
    rest = text[at:].split("boxed" if text.startswith("\\boxed", at) else "fbox", 1)[1]
    if rest[:1] == " ":
        return rest[1:].split("$")[0].strip() or None
    depth = 0
    for i, c in enumerate(rest):
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return rest[1:i] if rest[0] == "{" else None
        elif depth == 0:
            return None
    return None


def boxes(text: str | None, commands: tuple[str, ...] = ("\\boxed", "\\fbox")) -> list[str]:
    """Contents of all boxes with balanced braces, outer ones before those inside them; unbalanced ones are left out."""
    out = []
    for m in re.finditer("|".join(re.escape(c) + r"\s*\{" for c in commands), text or ""):
        depth = 1
        for i in range(m.end(), len(text)):
            depth += (text[i] == "{") - (text[i] == "}")
            if depth == 0:
                out.append(text[m.end() : i])
                break
    return out


def last_complete_box(text: str | None) -> str | None:
    """Content of the last \\boxed{..} that is closed, a later one that isn't notwithstanding; None without one."""
    found = boxes(text, ("\\boxed",))
    return found[-1] if found else None


def innermost_box(text: str | None) -> str | None:
    """Content of the last box; of a box in a box, the inner one's."""
    found = last_boxed(text)
    while found is not None and (inner := last_boxed(found)) is not None:
        found = inner
    return found


def normalize_latex(text: str) -> str:
    """A plain form of short LaTeX answers: spacing and size commands out, fractions and roots braced, a/b as a fraction."""
    t = text.replace("\n", "").replace("\\!", "").replace("\\\\", "\\").replace("tfrac", "frac").replace("dfrac", "frac")
    for x in ("\\left", "\\right", "^{\\circ}", "^\\circ", "\\$", "$", "\\%", "%", "\\,", "\\;", "\\ "):
        t = t.replace(x, "")
    t = re.sub(r"\\(?:text|mbox|mathrm|textbf)\{([^{}]*)\}\s*$", lambda m: "" if " " in m[0] or not m[1].isdigit() and m.start() else m[1], t.strip())
    if t.count("=") == 1 and len(t.split("=")[0].strip()) <= 2:
        t = t.split("=")[1]
    t = re.sub(r"\\sqrt\s*([^{\s\\])", r"\\sqrt{\1}", t)
    t = re.sub(r"\\frac\s*([^{\s\\])\s*([^{\s\\])", r"\\frac{\1}{\2}", t)
    t = re.sub(r"\\frac\s*(\{[^{}]*\})\s*([^{\s\\])", r"\\frac\1{\2}", t)
    t = re.sub(r"\\frac\s*([^{\s\\])\s*(\{)", r"\\frac{\1}\2", t).replace(" ", "")
    if t.startswith("."):
        t = "0" + t
    t = re.sub(r"(?<=[{,(])\.(?=\d)", "0.", t)
    if re.fullmatch(r"-?\d+/\d+", t):
        a, b = t.split("/")
        t = f"{'-' if a.startswith('-') else ''}\\frac{{{a.lstrip('-')}}}{{{b}}}"
    return t.rstrip(".")


def as_fraction(text: str) -> Fraction | None:
    """Exact value of integers, decimals, percentages without sign, thousands, a/b and simple \\frac; None for anything else."""
    t = text.strip().replace("{,}", "").strip("()") if not re.search(r"[a-zA-Z]", text.replace("\\frac", "")) else ""
    t = re.sub(r"(?<=\d),(?=\d{3}\b)", "", t)
    if m := re.fullmatch(r"(-?)\\frac\{(-?[\d.]+)\}\{(-?[\d.]+)\}", t):
        t = f"{m[1]}{m[2]}/{m[3]}".replace("--", "")
    try:
        if m := re.fullmatch(r"(-?\d*\.?\d+)/(-?\d*\.?\d+)", t):
            return Fraction(m[1]) / Fraction(m[2])
        return Fraction(t) if re.fullmatch(r"-?\d+\.?\d*|-?\.\d+", t) and len(t) < 200 else None
    except (ZeroDivisionError, ValueError):
        return None


def _pieces(t: str) -> list[str] | None:
    """Members of a tuple, interval or set, with its brackets; None if it isn't one."""
    if len(t) > 2 and t[0] in "([{" and t[-1] in ")]}":
        out, depth, part = [], 0, ""
        for c in t[1:-1]:
            depth += (c in "([{") - (c in ")]}")
            if c == "," and depth == 0:
                out.append(part)
                part = ""
            else:
                part += c
        return [t[0] + t[-1], *out, part] if out else None
    return None


def math_equal(answer: str | None, truth: str | None, tolerance: Fraction = Fraction(1, 10**9)) -> bool:
    """Equal normal forms, equal values, or tuples whose members are equal in order and with the same brackets."""
    if answer is None or truth is None:
        return False
    a, b = normalize_latex(answer), normalize_latex(truth)
    if a == b:
        return a != ""
    p, q = _pieces(a), _pieces(b)
    if p and q:
        return len(p) == len(q) and p[0] == q[0] and all(math_equal(x, y) for x, y in zip(p[1:], q[1:]))
    if p or q:
        return False
    x, y = as_fraction(a), as_fraction(b)
    if x is None or y is None:
        return algebra.same(a, b)
    return abs(x - y) <= tolerance * max(abs(x), abs(y), 1)


#: Units that a graded answer may carry (fixed values).
UNITS = ("degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter")
#: Words for large numbers (fixed values).
NUMBER_WORDS = {"million": 6, "billion": 9, "trillion": 12}
_UNIT = re.compile(rf"(?<![a-z\\])(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?:es|s)? *(?:\^[0-9]+)?(?![a-z])")


def graded_form(text: str) -> str:
    """The form in which answers are graded: signs of money and percent, units and degrees out, number words written out,
    fractions of integers as a/b, thousands without commas, lower case, integral decimals as integers."""
    t = re.sub(r"^\\text\{(.+)\}$", r"\1", text.strip()).lower()
    for a, b in (("\\%", ""), ("%", ""), ("\\$", ""), ("$", ""), (" or ", ","), (" and ", ","), ("\\!", ""), ("\\left", ""), ("\\right", ""), ("dfrac", "frac"), ("tfrac", "frac")):
        t = t.replace(a, b)
    t = re.sub(r"\^ *(?:\\circ|\{\\circ\})", "", _UNIT.sub("", t))
    t = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", t) if not re.match(r"[(\[{]", t.strip()) else t
    for word, zeros in NUMBER_WORDS.items():
        t = re.sub(rf"(\d+\.?\d*) *{word}s?(?![a-z])", lambda m: str(Fraction(m[1]) * 10**zeros), t)
    t = re.sub(r"\\frac\{(-?\d+)\}\{(-?\d+)\}", r"\1/\2", t.strip())
    if t.startswith("{") and t.endswith("}") and "," not in t:
        t = t[1:-1]
    return _integer(t) or re.sub(r"\s+", " ", t)


def _integer(t: str) -> str | None:
    """The digits of an integer that is written as any decimal number, else None."""
    if re.fullmatch(r"-?(?:\d+\.?\d*|\.\d+)(?:e\+?\d{1,3})?", t.strip()):
        x = Fraction(t.strip().rstrip("."))
        return str(x) if x.denominator == 1 else None
    return None


def _same_member(answer: str, truth: str) -> bool:
    a, b = answer.strip(), truth.strip()
    x, y = _integer(a), _integer(b)
    if x is not None or y is not None:
        return x == y  # an integer wants an integer
    if all(re.fullmatch(r"-?\d+/\d+", t) for t in (a, b)):
        return a == b  # fractions must be the same, reduced or not
    return a == b or algebra.same(a, b)


def grade_answer(answer: str | None, truth: str | None) -> bool:
    """Whether an answer counts as the truth: equal forms; or as many members in the same brackets, each an equal integer,
    the same fraction, or an expression of the same value."""
    if answer is None or truth is None:
        return False
    plain = normalize_latex(answer)
    if plain and plain == normalize_latex(truth):
        return True
    a, b = graded_form(answer), graded_form(truth)
    if a == b or not a:
        return a == b
    p, q = _pieces(a), _pieces(b)
    if p and q:
        return len(p) == len(q) and p[0] == q[0] and all(map(_same_member, p[1:], q[1:]))
    return not p and not q and _same_member(a, b)


def strict_form(text: str) -> str:
    """The string form under which two short LaTeX answers are compared as strings, after the published benchmark's rules.

    Line ends, `\\!`, size commands, degrees, escaped dollar and percent signs go; `\\\\` is one backslash; a unit in a last
    \\text{ ..} goes; a leading point gets its zero; a short left side of one equation goes; roots and fractions get
    braces; blanks go; 0.5 is \\frac{1}{2}; a/b of integers is \\frac{a}{b}. Nothing is evaluated: 9.0 isn't 9.
    """
    t = text
    for a, b in STRICT_RULES:
        t = t.replace(a, b)
    head, unit, _ = t.partition("\\text{ ")
    t = head if unit else t
    t = re.sub(r"(^|(?<=[ {]))\.", "0.", t.replace("\\%", ""))
    left, is_, right = t.partition("=")
    if is_ and "=" not in right and len(left) <= 2:
        t = right
    t = re.sub(r"\\sqrt(?!\{)(.)", r"\\sqrt{\1}", t).replace(" ", "")
    t = re.sub(r"\\frac(?!\{)(.)(?!\{)(.)", r"\\frac{\1}{\2}", t)
    t = re.sub(r"\\frac(?!\{)(.)(?=\{)", r"\\frac{\1}", t)
    if t == "0.5":
        t = "\\frac{1}{2}"
    if m := re.fullmatch(r"(-?\d+)/(-?\d+)", t):
        t = f"\\frac{{{int(m[1])}}}{{{int(m[2])}}}" if t == f"{int(m[1])}/{int(m[2])}" else t
    return t


#: Replacements of the strict normal form, in this order (fixed values).
STRICT_RULES = (
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
)


def strict_equal(answer: str | None, truth: str | None) -> bool:
    """Equal strings in the strict form; as they are, if one has several units. Two missing answers are equal, one is not."""
    if answer is None or truth is None:
        return answer is truth
    if max(answer.count("\\text{ "), truth.count("\\text{ ")) > 1:
        return answer == truth
    return strict_form(answer) == strict_form(truth)


@F.pandas_udf(BooleanType())
def strict_equal_udf(answers: pd.Series, truths: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and strict_equal(x, y) for x, y in zip(answers, truths)])


@F.pandas_udf(StringType())
def boxed_udf(texts: pd.Series) -> pd.Series:
    return texts.map(last_boxed)


@F.pandas_udf(StringType())
def complete_box_udf(texts: pd.Series) -> pd.Series:
    return texts.map(last_complete_box)


@F.pandas_udf(StringType())
def innermost_box_udf(texts: pd.Series) -> pd.Series:
    return texts.map(innermost_box)


@F.pandas_udf(BooleanType())
def math_equal_udf(answers: pd.Series, truths: pd.Series) -> pd.Series:
    return pd.Series([math_equal(x, y) for x, y in zip(answers, truths)])


@F.pandas_udf(BooleanType())
def grade_udf(answers: pd.Series, truths: pd.Series) -> pd.Series:
    return pd.Series([grade_answer(x, y) for x, y in zip(answers, truths)])


def boxed_reward(text: Column, truth: Column) -> Column:
    """1 if the last box holds the truth, else 0."""
    return F.when(F.coalesce(math_equal_udf(boxed_udf(text), truth), F.lit(False)), 1.0).otherwise(0.0)


def strict_boxed_reward(text: Column, truth: Column) -> Column:
    """1 if the last box holds the truth as a string in the strict normal form, else 0."""
    return F.when(F.coalesce(strict_equal_udf(boxed_udf(text), truth), F.lit(False)), 1.0).otherwise(0.0)


def graded_boxed_reward(text: Column, truth: Column) -> Column:
    """1 if the last box holds an answer that grades as the truth, else 0."""
    return F.when(F.coalesce(grade_udf(boxed_udf(text), truth), F.lit(False)), 1.0).otherwise(0.0)


def geometry_reward(text: Column, truth: Column) -> Column:
    """0.9 for the answer in the last box, 0.1 for the format."""
    return 0.9 * graded_boxed_reward(text, truth) + 0.1 * format_reward(text)


#: Data sources by scorer (fixed values).
SOURCES = {
    "gsm8k": ("openai/gsm8k",),
    "boxed": ("lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500"),
    "minerva": ("math_dapo", "math", "math_dapo_reasoning"),
    "graded": ("numina_aops_forum", "numina_synthetic_math", "numina_amc_aime", "numina_synthetic_amc", "numina_cn_k12", "numina_olympiads"),
    "geometry": ("hiyouga/geometry3k",),
    "qa": ("searchR1_nq", "searchR1_triviaqa", "searchR1_popqa", "searchR1_hotpotqa", "searchR1_2wikimultihopqa", "searchR1_musique", "searchR1_bamboogle"),
}
#: Sources whose answers are programs, which this library doesn't run (fixed values).
PROGRAMS = ("codecontests", "apps", "codeforces", "taco")


def score_by_source(source: Column, text: Column, truth: Column) -> Column:
    """Score of an answer by its data source, which must be one of SOURCES or begin with `aime`; others are errors when run."""
    run = {
        "gsm8k": exact_score(gsm8k_strict(text), truth),
        "boxed": strict_boxed_reward(text, truth),
        "minerva": minerva_score(text, truth),
        "graded": graded_boxed_reward(text, truth),
        "geometry": geometry_reward(text, truth),
        "qa": qa_exact(text, truth),
    }
    out = F.when(source.startswith("aime"), run["minerva"])
    for name, score in run.items():
        out = out.when(source.isin(*SOURCES[name]), score)
    out = out.when(source.isin(*PROGRAMS), F.raise_error(F.concat(F.lit("programs are not run: "), source)).cast("double"))
    return out.otherwise(F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce(source, F.lit("null")))).cast("double"))
