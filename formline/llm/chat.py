"""Chat formatting: conversations rendered by a compiled template, with the spans that the loss counts.

Rows are brought together by conversation and sorted by turn inside each partition; a task then renders one conversation
after another from the sorted stream, so it holds one at a time. A single conversation is the unit that must fit a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.chat_template import Controls, as_text, compile_template
from formline.llm.common import shuffle_partitions

CONTROLS = ("<|turn|>", "<|says|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = """\
{%- for message in messages -%}
<|turn|>{{ message.role | escape }}<|says|>
{%- if message.role == 'assistant' -%}
{% generation %}{{ message.text | escape }}{% endgeneration %}
{%- else -%}
{{ message.text | escape }}
{%- endif -%}
<|end|>
{%- endfor -%}"""
_TURN = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>", re.S)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[dict]]]:
    now, held, any_row = None, [], False
    for batch in batches:
        for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if any_row and conv != now:
                yield now, held
                held = []
            now, any_row = conv, True
            held.append({"turn": turn, "role": as_text(role), "text": as_text(text)})
    if any_row:
        yield now, held


def format_conversations(
    turns: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code points [first, last) under generation marks).

    The template sees ``messages``, a list of turn, role and text in the order of turn (ties by role, then text); null roles
    and texts are empty. Rows with a null conversation id are one conversation. Repeated rows are turns like any other.
    Extra columns are ignored. ``escape`` is the filter that makes control strings inside a text harmless.
    """
    compile_template(template, {"escape": Controls(controls).escape})  # a faulty template fails here, not in a task
    schema = "conv_id bigint, formatted string, loss_spans array<struct<first:int,last:int>>"
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template, {"escape": Controls(controls).escape})
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            ids, texts, spans = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, spans_type)], names=["conv_id", "formatted", "loss_spans"]
            )

        for conv, messages in _conversations(batches):
            text, spans = run({"messages": messages})
            held.append((conv, text, [{"first": a, "last": b} for a, b in spans]))
            size += len(text)
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    rows = turns.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
    )
    together = rows.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return together.mapInArrow(render, schema)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a text that ``TEMPLATE`` wrote."""
    turns, end = [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != end:
            break
        turns.append((Controls.unescape(found[1]), Controls.unescape(found[2])))
        end = found.end()
    if end != len(formatted):
        raise ValueError(f"no turn at character {end}")
    return turns


def output_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted texts."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns, sha = read_back(text), hashlib.sha256()
                for role, said in turns:
                    sha.update(f"{role}\n{said}\n".encode())
                loss = "".join(Controls.unescape(text[s["first"]:s["last"]]) for s in spans)
                out.append((len(turns), sha.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.mapInArrow(digest, schema)
