"""Entity candidates and their clean-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import values as V
from quire.functions.text import let, norm

#: First words of column headers and pieces of paths that are no entities.
HEADER_WORDS = (
    "List", "Text", "Debit", "Credit", "Balance", "Total", "Amount", "Date", "Type", "Rate", "Line", "Description", "Context", "Messages",
    "Conversion", "Ledger", "Journal", "Account", "Accounts", "Transaction", "Source", "Trans", "Pages", "Document", "Record", "Entry", "Entries", "Posting",
    "Period", "Fiscal", "Budget", "Forecast", "Actual", "Variance", "Currency", "Exchange", "Adjustment", "Accrual", "Invoice", "Receipt", "Payment", "Deposit",
    "Withdrawal", "Transfer", "Principal", "Interest", "Fee", "Charge", "Discount", "Rebate", "Opening", "Closing", "Beginning", "Ending", "Sub", "Total",
    "Grand", "Net", "Gross", "Tax", "Rate", "Code", "Ref", "Reference", "Number", "No.", "Colomn", "Column", "Row", "Sheet",
    "Tab", "Page", "Name", "Value", "Field",
)
WEB = r"(?i)(^|[^A-Za-z0-9_])Web\s*Page($|[^A-Za-z0-9_])|(^|[^A-Za-z0-9_])www\.[A-Za-z0-9_]|\.(com|org|net)($|[^A-Za-z0-9_])"
PATH_PIECES = r"[a-z]:\\|[\\/]users[\\/]|[\\/]home[\\/]|\\\\|[\\/]{2,}|\.(exe|dll|py|txt|pdf|docx|xlsx|csv|json|xml|html|htm|pptx|ppt|doc|xls)($|[^A-Za-z0-9_])"


def is_garbage(value: Column) -> Column:
    """Codes, numbers, cell references, headers, links and paths: what no entity looks like. True for null."""

    def judge(v: Column) -> Column:
        s = F.trim(v)
        letters = F.length(F.regexp_replace(v, r"[^\p{L}]", ""))
        words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
        shouted = F.forall(F.filter(words, lambda w: F.length(w) > 1), lambda w: ((F.upper(w) == w) & (F.lower(w) != w)) | ~w.rlike(r"^\p{L}"))
        rules = [
            F.length(v) < 2, F.length(v) > 80, letters < 2, (F.length(v) > 4) & (letters / F.length(v) < 0.4), s.rlike(r"^\p{Lu}{1,4}$"), s.rlike("^[A-Z0-9]{6,}$"),
            s.rlike(r"^-?[0-9][0-9.,\-]*$"), s.rlike(r"^[0-9]{1,3}(,[0-9]{3})+$"), s.rlike(r"^-?[0-9]+\.?[0-9]*[Ee][+\-]?[0-9]+$"), s.rlike(r"^(col|row)_|\$[A-Z]+\$?[0-9]+|^[A-Z]+[0-9]+:[A-Z]+[0-9]+$"),
            F.contains(s, F.lit("=")) & (F.length(F.regexp_replace(s, "[^0-9]", "")) > 3), s.rlike(rf"(?i)^({'|'.join(w for w in HEADER_WORDS if w != 'No.')})($|[^A-Za-z0-9_])|^No\.[A-Za-z0-9_]"), (F.size(words) >= 3) & shouted,
            s.rlike(WEB), v.rlike(f"(?i){PATH_PIECES}"),
        ]
        out = F.lit(False)
        for r in rules:
            out = out | r
        return out

    return let(F.coalesce(value, F.lit("")), judge)


def distinct_first(values: Column, limit: int) -> Column:
    """The first `limit` values that differ after normalising, in order."""
    keyed = F.transform(values, lambda v, i: F.struct(norm(v).alias("k"), i.alias("i"), v.alias("v")))
    return let(keyed, lambda a: F.slice(F.transform(F.filter(a, lambda x: ~F.exists(a, lambda y: (y["k"] == x["k"]) & (y["i"] < x["i"]))), lambda x: x["v"]), F.lit(1), F.lit(limit)))


def proper_names(text: Column, limit: int = 10) -> Column:
    """Runs of two to four capitalised words that aren't garbage."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){1,3}"), F.lit(0))
    return distinct_first(F.filter(F.array_distinct(found), lambda v: ~is_garbage(v)), limit)


def first_money(text: Column) -> Column:
    """The first amount with a currency sign, else the first amount, else empty."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(V.MONEY), F.lit(0))
    return let(found, lambda a: F.coalesce(F.get(F.filter(a, lambda x: x.rlike("[₹$€£]")), F.lit(0)), F.get(a, F.lit(0)), F.lit("")))
