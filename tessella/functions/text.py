"""Text and message functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that mark a paragraph as an instruction (fixed values).
INSTRUCTION_MARKERS = ("reason step by step", "final answer", "\\boxed{}", "boxed{}", "assistant", "math problem", "question:")
TRUE_WORDS = ("1", "true", "yes", "y", "on")


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def to_messages(text: Column) -> Column:
    """A plain string is one user message; null is no message."""
    one = F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))
    return F.when(text.isNull(), F.slice(one, 1, 0)).otherwise(one)


def join_contents(messages: Column, roles: tuple[str, ...] | None = None) -> Column:
    """Stripped, non-empty contents of the messages of these roles, a blank line between them."""
    own = messages if roles is None else F.filter(messages, lambda m: F.lower(m["role"]).isin(*roles))
    return F.array_join(F.filter(F.transform(own, lambda m: strip(F.coalesce(m["content"], F.lit("")))), lambda t: t != ""), "\n\n")


def question_text(messages: Column, mode: str = "user_only") -> Column:
    """The user's text, or all messages' if that is empty; the modes all and system_user join all messages."""
    if mode not in ("user_only", "all", "system_user"):
        raise ValueError(f"unknown mode {mode}")
    if mode != "user_only":
        return join_contents(messages)
    own = join_contents(messages, ("user",))
    return F.when(own != "", own).otherwise(join_contents(messages))


def build_input_text(question: Column, answer: Column | None = None) -> Column:
    if answer is None:
        return question
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\nAnswer:\n"), answer)


def input_text(question: Column, mode: str = "question_only", truth: Column | None = None, target: Column | None = None) -> Column:
    """Text to embed: the question alone, with the truth, or with the worked answer; a missing or empty one is an error when run."""
    if mode == "question_only":
        return build_input_text(question)
    if mode == "question_plus_ground_truth" and truth is not None:
        return build_input_text(question, required(truth, "ground truth"))
    if mode == "question_plus_cot" and target is not None:
        return build_input_text(question, required(first_content(target), "target"))
    raise ValueError(f"unknown mode {mode}, or its column is missing")


def required(text: Column, what: str) -> Column:
    """The stripped text; an error when run where it is null or empty."""
    t = strip(text.cast("string"))
    return F.when(F.coalesce(t, F.lit("")) != "", t).otherwise(F.raise_error(F.lit(f"missing or empty {what}")))


# content of mixed kinds: VARIANT values, as parse_json makes them


def variant(text: Column) -> Column:
    """JSON text as a VARIANT; any other text as the string that it is; null for null."""
    return F.coalesce(F.try_parse_json(text), _string_variant(text))


def _string_variant(text: Column) -> Column:
    return F.when(text.isNotNull(), F.try_variant_get(F.parse_json(F.to_json(F.struct(text.alias("t")))), "$.t", "variant"))


def _kind(v: Column) -> Column:
    """`object`, `array`, `string` or other names in lower case; null for a null."""
    return F.lower(F.regexp_extract(F.schema_of_variant(v), r"^[A-Za-z]+", 0))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def plain_text(v: Column) -> Column:
    """Text of a VARIANT: strings as they are, null as empty, numbers and booleans in their own form, the rest as JSON."""
    return F.when(v.isNull() | F.is_variant_null(v), "").when(_kind(v) == "string", _get(v, "$")).otherwise(F.to_json(v))


def _part_text(v: Column) -> Column:
    """Text of one part of a content: of an object its `text`, else its `content`."""
    inner = F.coalesce(*[F.when(~F.is_variant_null(_get(v, p, "variant")), _get(v, p, "variant")) for p in ("$.text", "$.content")])
    return F.when(_kind(v) == "object", plain_text(inner)).otherwise(plain_text(v))


def flatten_content(v: Column) -> Column:
    """Text of a content of any kind; the non-empty, stripped parts of a list, a line each."""
    parts = F.filter(F.transform(_get(v, "$", "array<variant>"), lambda p: strip(_part_text(p))), lambda t: t != "")
    return F.when(v.isNull(), "").when(_kind(v) == "array", F.array_join(parts, "\n")).otherwise(_part_text(v))


def _items(v: Column) -> Column:
    """The members of a list, or the value itself as its only one; none for null."""
    none = F.array().cast("array<variant>")
    return F.when(v.isNull() | F.is_variant_null(v), none).when(_kind(v) == "array", _get(v, "$", "array<variant>")).otherwise(F.array(v))


def message_list(v: Column) -> Column:
    """Messages (role, content) of a VARIANT: objects with a content as they are, other objects as the user's JSON text,
    strings as the user's; null is no message."""

    def one(x: Column) -> Column:
        named = (_kind(x) == "object") & _get(x, "$.content", "variant").isNotNull()
        role = F.when(named, F.coalesce(_get(x, "$.role"), F.lit(""))).otherwise("user")
        return F.struct(role.alias("role"), F.when(named, plain_text(_get(x, "$.content", "variant"))).otherwise(plain_text(x)).alias("content"))

    return F.transform(_items(v), one)


def prompt_messages(v: Column) -> Column:
    """Messages with flattened, stripped contents and lower-case roles (none: empty); empty contents are dropped."""

    def one(x: Column) -> Column:
        object_ = _kind(x) == "object"
        role = F.when(object_, F.lower(strip(F.coalesce(_get(x, "$.role"), F.lit(""))))).otherwise("")
        content = F.when(object_, flatten_content(_get(x, "$.content", "variant"))).otherwise(flatten_content(x))
        return F.struct(role.alias("role"), strip(content).alias("content"))

    return F.filter(F.transform(_items(v), one), lambda m: m["content"] != "")


def first_content(target: Column) -> Column:
    """Stripped content of a target's first message, or the target itself if it is text; null if empty or missing."""
    v = target
    first = F.get(_get(v, "$", "array<variant>"), F.lit(0))
    text = F.when(_kind(v) == "array", F.when(_kind(first) == "object", plain_text(_get(first, "$.content", "variant")))).when(_kind(v) == "string", _get(v, "$"))
    return F.nullif(strip(text), F.lit(""))


def target_text(v: Column) -> Column:
    """Text of a target: the contents of its messages, a line each, of its one message, or the text that it is."""
    of = lambda x: F.when(_kind(x) == "object", flatten_content(_get(x, "$.content", "variant"))).otherwise(flatten_content(x))
    parts = F.filter(F.transform(_get(v, "$", "array<variant>"), lambda x: strip(of(x))), lambda t: t != "")
    one = F.when(_kind(v) == "object", of(v)).otherwise(plain_text(v))
    return F.when(v.isNull(), "").when(_kind(v) == "array", F.array_join(parts, "\n")).otherwise(strip(one))


def truth_of(columns: list[Column]) -> Column:
    """The first of the columns that isn't empty; an error when run if all are."""
    return required(first_non_empty(columns), "ground truth")


def user_text(messages: Column) -> Column:
    """Contents of the user's messages as they are, a line each."""
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


def prompt_of(template: str, question: Column) -> Column:
    """One user message: the template, in which {question} stands for the stripped question."""
    before, _, after = template.partition("{question}")
    return F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit(before), strip(question), F.lit(after)).alias("content")))


def dataset_name(path: Column) -> Column:
    """Name for files: the last part of a path or id, without its suffix, sanitised; `dataset` if nothing is left."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"^.*/", ""), r"(?i)\.(parquet|json|jsonl)$", "")
    return F.coalesce(F.nullif(sanitize_name(base), F.lit("")), F.lit("dataset"))


def output_name(path: Column, fraction: float, seed: int) -> Column:
    """The dataset's name, with the fraction's digits and the seed if only a part was taken."""
    if fraction >= 1.0:
        return dataset_name(path)
    return F.concat(dataset_name(path), F.lit(f"_frac{f'{fraction:g}'.replace('0.', '')}_seed{seed}"))


def json_or_text(value: Column, kind: str) -> Column:
    """JSON of arrays, structs, maps and variants; other values as text."""
    return F.to_json(value) if kind.startswith(("struct", "array", "map", "variant")) else value.cast("string")


def loss_mask(messages: Column, roles: tuple[str, ...] = ("assistant",)) -> Column:
    """1 for each message of these roles, 0 for the others."""
    return F.transform(messages, lambda m: m["role"].isin(*roles).cast("int"))


def normalize_messages(messages: Column) -> Column:
    """Roles lower case and stripped (empty: user), contents stripped, empty ones dropped."""
    clean = F.transform(messages, lambda m: F.struct(F.coalesce(F.nullif(F.lower(strip(m["role"])), F.lit("")), F.lit("user")).alias("role"), strip(F.coalesce(m["content"], F.lit(""))).alias("content")))
    return F.filter(clean, lambda m: m["content"] != "")


def looks_like_instruction(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for marker in INSTRUCTION_MARKERS:
        out = out | low.contains(marker)
    return out


#: Tags that stand before a question (fixed values).
TAGS = ("Question:", "Problem:", "Q:")


def strip_instruction(text: Column) -> Column:
    """The question without what instructs: line ends to \\n, a trailing <think> off, a first paragraph that instructs off;
    then what follows the last tag after an instruction, or a tag at the start, in any case of letters. Nothing is taken
    off that would leave nothing."""
    without_think = lambda c: strip(F.regexp_replace(c, r"(?i)\s*<think>\s*$", ""))
    t = without_think(strip(F.replace(text, F.lit("\r\n"), F.lit("\n"))))
    rest = strip(F.regexp_replace(t, r"^[\s\S]*?\n\n", ""))
    t = F.when(t.contains("\n\n") & looks_like_instruction(F.substring_index(t, "\n\n", 1)) & (rest != ""), rest).otherwise(t)

    def after_last(tag: str) -> Column:
        tail = F.char_length(F.substring_index(F.lower(t), tag.lower(), -1))
        at = F.char_length(t) - tail - len(tag)
        found = strip(F.right(t, tail))
        return F.when(F.lower(t).contains(tag.lower()) & (at > 0) & looks_like_instruction(F.left(t, at)) & (found != ""), found)

    t = F.coalesce(*[after_last(tag) for tag in TAGS], t)

    def after_first(tag: str) -> Column:
        found = strip(F.substring(t, F.lit(len(tag) + 1), F.char_length(t)))
        return F.when(F.lower(t).startswith(tag.lower()) & (found != ""), found)

    return without_think(F.coalesce(*[after_first(tag) for tag in TAGS], t))


def extract_question(messages: Column, fallback: list[Column]) -> Column:
    """Last user or human message, else the last message, else the first non-empty fallback."""
    user = F.try_element_at(F.filter(messages, lambda m: F.lower(m["role"]).isin("user", "human")), F.lit(-1))["content"]
    last = F.try_element_at(messages, F.lit(-1))["content"]
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in (user, last, *fallback)])


def first_non_empty(columns: list[Column]) -> Column:
    return F.coalesce(*[F.nullif(strip(c.cast("string")), F.lit("")) for c in columns])


def sanitize_name(text: Column) -> Column:
    """Anything but letters, digits, dot, dash and underscore becomes one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(strip(text), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def to_optional_int(text: Column) -> Column:
    """Integers and integral decimals in text; null for the rest."""
    d = strip(text).try_cast("double")
    return F.when(d.isNotNull() & (F.abs(d) < 9.0e15) & (d == F.floor(d)), d.cast("long"))


def to_bool(text: Column) -> Column:
    return F.lower(strip(text)).isin(*TRUE_WORDS)


#: A LaTeX command, or one character that is neither a letter nor white space.
NOISE = r"\\[a-z]+|[^a-z\s]"


def clean_text(text: Column) -> Column:
    """Lower case; LaTeX commands, numbers, delimiters, other non-letters and then single letters out; spaces collapsed."""
    t = F.regexp_replace(F.lower(text), NOISE, " ")  # a number or a delimiter is no letter: one pass takes them all
    return strip(F.regexp_replace(F.regexp_replace(t, r"\b[a-z]\b", " "), r"\s+", " "))


def clean_words(text: Column) -> Column:
    """The words of two letters or more of the cleaned text, in one pass."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\\[a-z]+|([a-z]+)"), F.lit(1)), lambda w: F.length(w) > 1)


def ensure_sample_id(direct: Column, index: Column, row: Column) -> Column:
    """The id itself if it is integral; else a non-negative index of the extra information; else the row's number."""
    own = to_optional_int(direct.cast("string"))
    return F.coalesce(own, F.when(index >= 0, index.cast("long")), row.cast("long"))


def patch_struct(extra: Column, **fields: Column) -> Column:
    for name, value in fields.items():
        extra = extra.withField(name, value)
    return extra


def pad_or_cut(ids: Column, length: int, pad: Column, left: bool = False, cut: str = "right") -> Column:
    """Exactly `length` entries: cut at the given side (`error`: too many are an error when run), or padded at the left or right."""
    if cut not in ("left", "right", "error"):
        raise ValueError(f"unknown side {cut}")
    if cut == "error":
        ids = F.when(F.size(ids) <= length, ids).otherwise(F.raise_error(F.lit(f"more than {length} entries")))
    if cut == "left":
        kept = F.slice(ids, F.greatest(F.size(ids) - length + 1, F.lit(1)), F.lit(length))
    else:
        kept = F.slice(ids, 1, length)
    fill = F.array_repeat(pad, F.greatest(F.lit(length) - F.size(kept), F.lit(0)))
    return F.concat(fill, kept) if left else F.concat(kept, fill)


def unpad(ids: Column, mask: Column) -> Column:
    """Entries whose mask is 1."""
    return F.transform(F.filter(F.arrays_zip(ids.alias("x"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["x"])


def media_segments(text: Column) -> Column:
    """Text cut at <image> and <video> placeholders, which stay as segments of their own."""
    return F.filter(F.split(text, r"(?=<image>|<video>)|(?<=<image>)|(?<=<video>)"), lambda s: s != "")


def tool_calls(text: Column) -> Column:
    """Bodies of <tool_call> elements that are JSON objects with a name; none unless both tags occur."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    parsed = F.transform(found, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))
    return F.filter(parsed, lambda c: c["name"].isNotNull())


def text_without_tool_calls(text: Column) -> Column:
    return F.when(text.contains("<tool_call>") & text.contains("</tool_call>"), F.regexp_replace(text, r"(?s)<tool_call>.*?</tool_call>", "")).otherwise(text)


def entropy_from_logits(logits: Column) -> Column:
    """log-sum-exp minus the mean logit under the softmax, with the maximum taken out first."""
    top = F.array_max(logits)
    z = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    px = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top) * x) / z
    return F.ln(z) + top - px


def sum_squared_probabilities(logits: Column) -> Column:
    top = F.array_max(logits)
    z = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    z2 = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(2 * (x - top)))
    return z2 / (z * z)


def log_softmax_at(logits: Column, index: Column) -> Column:
    top = F.array_max(logits)
    return F.get(logits, index) - top - F.ln(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def workload(n: Column) -> Column:
    """Cost of a sequence of n tokens: linear layers plus attention."""
    return F.lit(24576) * n.cast("long") + n.cast("long") * n.cast("long")


def correctness(acc: Column, score: Column, token_sum: Column) -> Column:
    """acc clipped to [0, 1]; else whether the score, else whether the tokens' sum, is positive; NaN counts as 0."""
    clip = F.least(F.greatest(F.nanvl(acc.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    sign = lambda x: (F.nanvl(x.cast("double"), F.lit(0.0)) > 0).cast("double")
    return F.coalesce(F.when(acc.isNotNull(), clip), F.when(score.isNotNull(), sign(score)), sign(token_sum), F.lit(0.0))


def overlong_penalty(length: Column, limit: int, buffer: int, factor: float = 1.0) -> Column:
    return F.least(-(length - (limit - buffer)) / buffer * factor, F.lit(0.0))


def log_matches(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose text holds a part."""
    return df.where(F.col(column).contains(part))


def log_row(df: DataFrame, column: str, request: str) -> DataFrame:
    """The rows of one request."""
    return df.where(F.col(column) == request)


def sort_log(df: DataFrame, tie: str) -> DataFrame:
    """Add `order_score`, the score (else score_1, else 0), and sort by it, the highest first."""
    scores = [F.col(c).cast("double") for c in ("score", "score_1") if c in df.columns]
    return df.withColumn("order_score", F.coalesce(*scores, F.lit(0.0))).orderBy(F.desc("order_score"), tie)
