"""Preference formatting of conversation pairs.

Method.  The longest common prefix of the turns (role and text) of the chosen and the rejected conversation is rendered
once as prompt; the turns after it are rendered as two completions.  A mask tells which characters of a completion are
trained on: the text and end mark of assistant turns.  Everything is DataFrame functions: turns are gathered for each
pair, which is bounded by the two conversations, never for a group of pairs that share a prompt."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatParams:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    trained_role: str = "assistant"


def render(turns: Column, p: ChatParams) -> Column:
    """Turns (role, text) as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(p.start), t["role"], F.lit("\n"), t["text"], F.lit(p.end))), "")


def mask(turns: Column, p: ChatParams) -> Column:
    """(start, length) in characters of the trained parts of render(turns); one pass over the turns."""
    fixed = len(p.start) + 1
    size = lambda t: F.length(t["role"]) + F.length(t["text"]) + fixed + len(p.end)
    none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: long, length: long>>)").alias("parts"))

    def step(acc: Column, t: Column) -> Column:
        part = F.struct((acc["at"] + F.length(t["role"]) + fixed).cast("long").alias("start"), (F.length(t["text"]) + len(p.end)).cast("long").alias("length"))
        parts = F.when(t["role"] == p.trained_role, F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"])
        return F.struct((acc["at"] + size(t)).alias("at"), parts.alias("parts"))

    return F.aggregate(turns, none, step, lambda acc: acc["parts"])


def common_turns(a: Column, b: Column) -> Column:
    """How many first turns are the same in both."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.eqNullSafe(y))
    differ = F.array_position(pairs, F.lit(False)).cast("int")
    return F.when(differ > 0, differ - 1).otherwise(n)


def preference_pairs(turns: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """From turns(pair_id, side, turn, role, text), side chosen or rejected: pair_id, n_prompt_turns, prompt, chosen,
    rejected (completions), chosen_mask, rejected_mask.

    Null roles and texts count as empty; repeated rows count once; of turns with the same number, ties go by role and
    text; a side without turns is an empty conversation, so its pair has an empty prompt and an empty completion; rows
    without a pair id are left out; very long texts and conversations are rendered whole; an empty table gives an empty
    result; other columns don't matter."""
    p = params
    rows = turns.where("pair_id is not null").select("pair_id", "side", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    of = lambda side: F.transform(F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("t")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    both = rows.groupBy("pair_id").agg(of("chosen").alias("c"), of("rejected").alias("r"))
    both = both.withColumn("n", common_turns(F.col("c"), F.col("r")))
    rest = lambda x: F.slice(F.col(x), F.col("n") + 1, F.size(x))
    cut = both.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("prompt"), rest("c").alias("c"), rest("r").alias("r"))
    return cut.select(
        "pair_id", F.col("n").cast("long").alias("n_prompt_turns"), render(F.col("prompt"), p).alias("prompt"), render(F.col("c"), p).alias("chosen"), render(F.col("r"), p).alias("rejected"),
        mask(F.col("c"), p).alias("chosen_mask"), mask(F.col("r"), p).alias("rejected_mask"),
    )


def alternatives(conversations: DataFrame, role: str = "assistant") -> DataFrame:
    """turns(pair_id, side, turn, role, text): each conversation up to its last answer of `role` is chosen, and the same turns
    with the latest earlier answer of another text in its place are rejected, so neither side is empty.

    pair_id is conv_id.  A null text counts as empty.  Of turns with one number (ties, repeated rows) the least (role, text)
    counts; rows without conversation or turn and conversations without two different answers give nothing; very long texts
    and conversations stay whole; an empty table gives nothing; other columns don't matter."""
    rows = conversations.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("t"))
    whole = rows.groupBy(F.col("conv_id").alias("pair_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "t.role", "t.text"))).alias("all"))
    said = lambda t: F.coalesce(t["text"], F.lit(""))
    whole = whole.withColumn("answers", F.filter("all", lambda t: t["role"] == role)).where(F.size("answers") > 1)
    whole = whole.withColumn("last", F.element_at("answers", -1)).withColumn("others", F.filter("answers", lambda t: said(t) != said(F.col("last")))).where(F.size("others") > 0)
    last, before = F.col("last"), F.element_at("others", -1)
    mine = lambda side, t, says: F.struct(F.lit(side).alias("side"), t["turn"].alias("turn"), says["role"].alias("role"), says["text"].alias("text"))
    chosen = F.transform(F.filter("all", lambda t: t["turn"] <= last["turn"]), lambda t: mine("chosen", t, t))
    common = F.transform(F.filter("all", lambda t: t["turn"] < last["turn"]), lambda t: mine("rejected", t, t))
    other = F.array(mine("rejected", last, before))
    return whole.select("pair_id", F.explode(F.concat(chosen, common, other)).alias("s")).select("pair_id", "s.*")


def op6_chat_preference(spark, sf_dir: str) -> DataFrame:
    """The preference pair that each conversation gives (see alternatives), formatted.

    Masks are given as `start:length` lists, as text."""
    turns = alternatives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    shown = lambda m: F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["start"].cast("string"), x["length"].cast("string"))), ",").alias(m)
    return preference_pairs(turns).select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", shown("chosen_mask"), shown("rejected_mask"))


_P = ChatParams()
_END = _P.end.replace("\n", "' || chr(10) || '")


def _side(name: str) -> str:
    return f"""
{name}_rest as (select pair_id, turn, role, text, pos, '{_P.start}' || role || chr(10) || text || '{_END}' as s,
    coalesce(sum(length(role) + length(text) + {len(_P.start) + 1 + len(_P.end)}) over (partition by pair_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from t join n using (pair_id) where side = '{name}' and pos > n_prompt_turns),
{name}_out as (select pair_id, string_agg(s, '' order by pos) as {name},
    coalesce(string_agg((before + length(role) + {len(_P.start) + 1})::varchar || ':' || (length(text) + {len(_P.end)})::varchar, ',' order by pos) filter (where role = '{_P.trained_role}'), '') as {name}_mask
  from {name}_rest group by pair_id)"""


SQL = f"""
with one as (select conv_id, turn, role, text from conversations where conv_id is not null and turn is not null
  qualify row_number() over (partition by conv_id, turn order by role nulls first, text nulls first) = 1),
answers as (select conv_id, max(turn) as last from one where role = 'assistant' group by conv_id),
best as (select one.conv_id, coalesce(text, '') as said from one join answers on one.conv_id = answers.conv_id and turn = last),
before as (select conv_id, arg_max(coalesce(text, ''), turn) as text, max(turn) as turn from one join answers using (conv_id) join best using (conv_id) where role = 'assistant' and turn < last and coalesce(text, '') <> said group by conv_id),
both_sides as (select conv_id as pair_id, 'chosen' as side, turn, role, text from one join answers using (conv_id) where turn <= last and conv_id in (select conv_id from before)
  union all select conv_id, 'rejected', turn, role, text from one join answers using (conv_id) where turn < last and conv_id in (select conv_id from before)
  union all select b.conv_id, 'rejected', a.last, 'assistant', b.text from before b join answers a using (conv_id)),
d as (select distinct pair_id, side, turn, coalesce(role, '') as role, coalesce(text, '') as text from both_sides),
t as (select *, row_number() over (partition by pair_id, side order by turn, role, text) as pos from d),
sizes as (select pair_id, count(*) filter (where side = 'chosen') as a, count(*) filter (where side = 'rejected') as b from t group by pair_id),
same as (select c.pair_id, c.pos, c.role = r.role and c.text = r.text as eq from t c join t r on c.pair_id = r.pair_id and c.pos = r.pos and c.side = 'chosen' and r.side = 'rejected'),
n as (select sizes.pair_id, coalesce(min(pos) filter (where not eq) - 1, least(any_value(a), any_value(b)))::bigint as n_prompt_turns from sizes left join same using (pair_id) group by sizes.pair_id),
p as (select pair_id, string_agg('{_P.start}' || role || chr(10) || text || '{_END}', '' order by pos) as prompt from t join n using (pair_id) where side = 'chosen' and pos <= n_prompt_turns group by pair_id),
{_side("chosen")},
{_side("rejected")}
select n.pair_id, n_prompt_turns, coalesce(prompt, '') as prompt, coalesce(chosen, '') as chosen, coalesce(rejected, '') as rejected, coalesce(chosen_mask, '') as chosen_mask, coalesce(rejected_mask, '') as rejected_mask
from n left join p using (pair_id) left join chosen_out using (pair_id) left join rejected_out using (pair_id)
"""
