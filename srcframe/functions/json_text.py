"""What Spark's lenient JSON reader leaves open."""

from pyspark.sql import Column, functions as F, types as T

STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
_END = "_end_of_text"


def one_object(text: Column, schema: T.StructType) -> Column:
    """The text as ``schema``, null where it is not exactly one JSON object. One parse.

    Spark ignores what follows the first value. So the text is read as the first element of
    an array, with a mark of our own as the second: anything more, or an array that ends
    sooner, leaves the mark in another place.
    """
    marked = T.StructType([*schema.fields, T.StructField(_END, T.BooleanType())])
    held = F.from_json(F.concat(F.lit("["), text, F.lit(f',{{"{_END}":true}}]')), T.ArrayType(marked), {"allowSingleQuotes": "false"})

    def whole(both):
        first, last = F.get(both, F.lit(0)), F.get(both, F.lit(1))
        return F.when((F.size(both) == 2) & first.isNotNull() & F.coalesce(last[_END], F.lit(False)), first)

    # Bound by a lambda: a generator, unlike a projection, would parse again at every mention.
    return F.get(F.transform(F.array(held), whole), F.lit(0))


def is_one_object(text: Column) -> Column:
    """Whether the text is exactly one JSON object.

    Spark ignores what follows the first value. So the text is read as the only element of
    an array in an object, which then must have that one key and one element.
    """
    held = F.concat(F.lit('{"v":['), text, F.lit("]}"))
    read = F.from_json(held, "v array<map<string, string>>, _bad string", STRICT)
    one = (F.size(read["v"]) == 1) & read["_bad"].isNull() & (F.size(F.json_object_keys(held)) == 1)
    return F.coalesce(one & F.get(read["v"], F.lit(0)).isNotNull(), F.lit(False))
