"""Values by type: examples coerced or made up, and whether a member is required."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.operators.samples import quoted

WHOLE, DECIMAL = ("Int", "Long", "BigInteger"), ("Double", "BigDecimal")


def said(value: Column) -> Column:
    """The text of a JSON scalar: a string's characters, ``True`` or ``False``, a number as it is written."""
    text = F.get_json_object(F.concat(F.lit('{"x":'), value, F.lit("}")), "$.x")
    return F.when(value == "true", "True").when(value == "false", "False").when(value.startswith('"'), text).otherwise(value)


def coerced(value: Column, of_type: Column, names: Column) -> Column:
    """A JSON text as an example of a type, again as JSON text; null where it cannot be one.

    ``names``: the names of an enumeration, or null.  Null and empty values are none.  Numbers may have commas between
    their digits and stand in quotes; a decimal number without fraction is written as a whole one.
    """
    s = said(value)
    number = F.regexp_replace(F.trim(s), ",", "")
    a_bool, holds = value.isin("true", "false"), value.startswith("{") | value.startswith("[")
    whole = F.when(number.rlike(r"^[+-]?[0-9]+$"), number.try_cast("decimal(38,0)").cast("string"))
    real = F.when(number.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), number.try_cast("double"))
    decimal = F.when(real == F.floor(real), F.floor(real).cast("string")).otherwise(real.cast("string"))
    by_type = (
        F.when(of_type == "Boolean", F.when(a_bool, value).when(F.lower(s).isin("true", "false") & ~holds, F.lower(s)))
        .when(of_type.isin(*WHOLE), F.when(~a_bool & ~holds, whole))
        .when(of_type.isin(*DECIMAL), F.when(~a_bool & ~holds, decimal))
        .when(of_type.startswith("String"), F.when(~holds, quoted(s)))
        .when(of_type.startswith("Map"), F.when(value.startswith("{"), value))
        .when(of_type.startswith("List"), F.when(value.startswith("["), value))
        .otherwise(value)
    )
    there = value.isNotNull() & ~value.isin("null", '""')
    return F.when(there, F.when(names.isNotNull(), F.when(F.array_contains(names, s), value)).otherwise(by_type))


#: Examples of texts by what their names contain, the first that fits.
EXAMPLES = (
    (("date", "time", "tarikh"), "1400/11/11 - 06:11:16"),
    (("iban", "sheba", "shaba"), "IR890570000198900015002802"),
    (("deposit", "account"), "1.20.10504.1"),
    (("mobile", "phone"), "09121234567"),
    (("national", "melli"), "0012345678"),
    (("email",), "user@example.com"),
    (("key",), "key"),
    (("value",), "value"),
    (("title", "name", "desc", "comment"), "شرح نمونه"),
    (("code",), "1"),
)
#: An identifier, a sum of money, a rate.
NUMBER_EXAMPLE, SUM_EXAMPLE, RATE_EXAMPLE = "12081651201", "100000", "19"
SUMS = ("amount", "price", "balance")


def example(name: Column, of_type: Column, given: Column, names: Column, transaction_id: str) -> Column:
    """JSON text of an example for a member: the one that is given if it can be coerced, else the first name of its
    enumeration, else one made up from its type and name."""
    n = F.lower(name)
    has = lambda *parts: reduce(Column.__or__, [n.contains(p) for p in parts])
    text = F.when(n.contains("transactionid") | (n.endswith("id") & n.contains("transaction")), transaction_id)
    text = reduce(lambda w, x: w.when(has(*x[0]), x[1]), EXAMPLES, text)
    text = text.when(n.endswith("id") | has("identifier", "serial", "number"), NUMBER_EXAMPLE).otherwise("string")
    made = (
        F.when(of_type == "Boolean", "true")
        .when(of_type.isin(*WHOLE), F.when(has(*SUMS, "mablagh"), SUM_EXAMPLE).otherwise("1"))
        .when(of_type.isin(*DECIMAL), F.when(has(*SUMS), SUM_EXAMPLE).otherwise(RATE_EXAMPLE))
        .when(of_type.startswith("String"), quoted(text))
        .when(of_type.startswith("Map"), '{"key":"value"}')
        .when(of_type == "Object", "{}")
        .when(of_type == "File", '"<binary>"')
        .otherwise('"string"')
    )
    return F.coalesce(coerced(given, of_type, names), F.when(F.size(names) > 0, quoted(F.get(names, F.lit(0)))), made)


#: Annotations that say by themselves that a member is required, and types that cannot be missing.
ALWAYS = ("NotNull", "NotBlank", "NotEmpty", "NonNull", "Nonnull", "Required")
NEVER_MISSING = ("int", "long", "short", "byte", "boolean", "double", "float", "char")


def required(annotations: Column, type_name: Column, dims: Column, always: tuple[str, ...] = ALWAYS, primitives: tuple[str, ...] = NEVER_MISSING) -> Column:
    """Whether a member must be there: true, false, or null where nothing says so.

    ``annotations``: array of structs ``name, args`` (a map of texts), of which the first that says something counts.
    ``always``: names that say so by themselves.
    """

    def reading(a: Column) -> Column:
        name, flag = a["name"], F.try_element_at(a["args"], F.lit("required"))
        mode = F.substring_index(F.try_element_at(a["args"], F.lit("requiredMode")), ".", -1)
        schema = F.when(flag == "true", True).when(mode == "REQUIRED", True).when(mode == "NOT_REQUIRED", False)
        return (
            F.when(name.isin(*always), True).when(name == "Nullable", False).when(name == "Schema", schema)
            .when(name.isin("ApiModelProperty", "JsonProperty", "Parameter", "ApiParam"), F.when(flag.isNotNull(), flag == "true"))
        )

    said_so = F.get(F.filter(F.transform(annotations, reading), lambda x: x.isNotNull()), F.lit(0))
    by_type = F.when(F.substring_index(type_name, ".", -1) == "Optional", False).when(type_name.isin(*primitives) & (dims == 0), True)
    return F.coalesce(said_so, by_type)
