"""Chat formatting with typed content parts.

A turn is a role and a list of parts. A visitor (one expression per part type) flattens the parts in order: text stays
text, image, audio and document parts become placeholders that stand for a known number of tokens and are recorded as
attachments. Turns become `<|turn|>ROLE<|text|>TEXT<|end|>\\n`. Control strings inside roles and texts are escaped by a
backslash after their first character, and backslashes are doubled, so that no text can close its turn and everything
can be read back. The loss mask is a list of spans (start and length in code points) over the formatted string: the
texts of assistant turns.

All of it is DataFrame functions. Each turn is rendered before rows of a conversation meet; a conversation becomes one
string, so the longest one bounds the memory of a task.

Defined results: a null text is empty, a null role is the empty role, unknown part types are refused by name in the
output (`<|part:TYPE|>`); null parts are no parts; turns with equal numbers go by role and text, null turns come first; repeated rows are
repeated turns; a null conversation id is a conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "type string, text string, ref string, units bigint"
#: Tokens that one unit of a part stands for: an image tile, a second of audio, a page of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 800}
TRAINED_ROLE = "assistant"
TURN_END = "<|end|>\n"


def escaped(text: str) -> str:
    """SQL expression: `text` (an expression) with backslashes doubled and control strings broken."""
    doubled = f"replace({text}, '\\\\', '\\\\\\\\')"
    # also where a text ends inside a control string, which the next part could complete
    angle, square = "[|]|/?s>|/?SYS>|/?(s|SY?S?)?\\\\z", "/?INST\\\\]|/?(I|IN|INS|INST)?\\\\z"
    return f"regexp_replace({doubled}, '(<(?={angle})|\\\\[(?={square}))', '$1\\\\\\\\')"


def unescaped(text: str) -> str:
    return f"regexp_replace({text}, '(?s)\\\\\\\\(.|\\\\z)', '$1')"


def visited(parts: str) -> str:
    """SQL expression: the parts flattened to one already escaped string."""
    typed = " ".join(
        f"WHEN p.type = '{kind}' THEN concat('<|{kind}:', coalesce(p.units, 1L) * {tokens}, '|>')" for kind, tokens in TOKENS_PER_UNIT.items()
    )
    text = escaped("coalesce(p.text, '')")
    other = escaped("coalesce(p.type, '')")
    return f"concat_ws('', transform({parts}, p -> CASE WHEN p.type = 'text' THEN {text} {typed} ELSE concat('<|part:', {other}, '|>') END))"


def attachments(parts: str) -> str:
    """SQL expression: the attachment references in order, with the tokens each placeholder stands for."""
    kinds = ", ".join(f"'{k}'" for k in TOKENS_PER_UNIT)
    tokens = " ".join(f"WHEN p.type = '{k}' THEN {n}L" for k, n in TOKENS_PER_UNIT.items())
    return f"transform(filter({parts}, p -> p.type IN ({kinds})), p -> named_struct('type', p.type, 'ref', p.ref, 'tokens', coalesce(p.units, 1L) * (CASE {tokens} END)))"


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans, attachments, n_attachment_tokens.
    `parts` is array<struct<type, text, ref, units>>."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"), F.col(parts).alias("_parts"))
    rendered = rows.selectExpr(
        "conv_id", "_turn", "_role",
        f"concat('<|turn|>', {escaped('_role')}, '<|text|>') AS _head",
        f"{visited('_parts')} AS _body",
        f"coalesce({attachments('_parts')}, array()) AS _files",
    ).selectExpr("*", "CAST(char_length(_head) AS BIGINT) AS _skip", "CAST(char_length(_body) AS BIGINT) AS _length")
    earlier = "PARTITION BY conv_id ORDER BY _turn, _role, _body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    placed = rendered.selectExpr("*", f"coalesce(sum(_skip + _length + {len(TURN_END)}) OVER ({earlier}), 0L) AS _at")
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_at", "_role", "_head", "_body", "_skip", "_length", "_files"))).alias("_t"))
    out = whole.selectExpr(
        "conv_id",
        "CAST(size(_t) AS BIGINT) AS n_turns",
        "concat_ws('', transform(_t, x -> concat(x._head, x._body, '<|end|>\\n'))) AS formatted",
        f"transform(filter(_t, x -> x._role = '{TRAINED_ROLE}'), x -> named_struct('start', x._at + x._skip, 'length', x._length)) AS loss_spans",
        "flatten(transform(_t, x -> x._files)) AS attachments",
    )
    return out.selectExpr("*", "aggregate(attachments, 0L, (a, f) -> a + f.tokens) AS n_attachment_tokens")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds what can be read from the formatted string and the mask: `turns` (role and text, unescaped; placeholders
    stay as they are) and `loss_text`, all text under the mask."""
    # `<|turn|>` cannot occur inside a text, so it splits the string into turns.
    turn = "named_struct('role', substring_index(x, '<|text|>', 1), 'text', substring(x, instr(x, '<|text|>') + 8, char_length(x) - instr(x, '<|text|>') - 15))"
    pieces = f"transform(slice(split(formatted, '<[|]turn[|]>', -1), 2, CAST(n_turns AS INT)), x -> {turn})"
    plain = f"transform({pieces}, t -> named_struct('role', {unescaped('t.role')}, 'text', {unescaped('t.text')}))"
    masked = "transform(loss_spans, s -> substring(formatted, CAST(s.start AS INT) + 1, CAST(s.length AS INT)))"
    return formatted.selectExpr("*", f"{plain} AS turns", f"concat_ws('', transform({masked}, t -> {unescaped('t')})) AS loss_text")
