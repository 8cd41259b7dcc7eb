"""JSON5 text to JSON text, as column expressions: one pattern cuts the text into tokens, and each token is put right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Begins the text of what JSON has no number for; a private character, so that no answer has it.
MARK = "\ue000"

_LETTER = r"(?:[\p{L}\p{Nl}_$]|\\u[0-9a-fA-F]{4})"
_STRINGS = r""""[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'"""
_COMMENT = r"//[^\n\r\u2028\u2029]*+|/\*[\s\S]*?\*/"
_NAME = rf"{_LETTER}(?:{_LETTER}|[\p{{Mn}}\p{{Mc}}\p{{Nd}}\p{{Pc}}\u200c\u200d])*+"
_NUMBER = r"[+-]?(?:0[xX][0-9a-fA-F]++|(?:\d++\.?\d*+|\.\d++)(?:[eE][+-]?\d++)?|(?:Infinity|NaN)\b)"
# white space and comments lie between tokens; a character that begins no token stands alone, and spoils the JSON
_TOKEN = rf"{_STRINGS}|{_COMMENT}|{_NUMBER}|{_NAME}|[\s\ufeff]++|[\s\S]"
_PIECE = r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|\r\n|[\s\S])|[^\\]++"


def _escape(piece: Column) -> Column:
    """A piece of a string, an escape or plain text, as JSON writes it. What JSON5 doesn't know stays, and spoils the JSON."""
    kind = F.substr(piece, F.lit(2), F.lit(1))
    plain = F.replace(F.replace(piece, F.lit('"'), F.lit('\\"')), F.lit("\t"), F.lit("\\t"))
    return (
        F.when(~piece.startswith("\\"), plain)
        .when(kind.isin(*'bfnrtux"\\/123456789') & ~piece.rlike(r"^\\x.."), piece)
        .when(kind == "x", F.concat(F.lit("\\u00"), F.substr(piece, F.lit(3))))
        .when(kind == "v", F.lit("\\u000b"))
        .when(kind == "0", F.lit("\\u0000"))
        .when(kind.isin("\n", "\r", "\u2028", "\u2029"), F.lit(""))
        .otherwise(F.substr(piece, F.lit(2)))
    )


def _string(token: Column) -> Column:
    body = F.substr(token, F.lit(2), F.length(token) - 2)
    pieces = F.regexp_extract_all(body, F.lit(_PIECE), F.lit(0))
    return F.concat(F.lit('"'), F.array_join(F.transform(pieces, _escape), ""), F.lit('"'))


def _number(token: Column) -> Column:
    """Decimal as JSON writes it; a hex number of more than 64 bits and what is no finite number become marked strings."""
    sign = F.when(token.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    bare = F.regexp_replace(token, "^[+-]", "")
    digits = F.regexp_replace(bare, "^0[xX]0*(?=.)", "")
    dotted = F.regexp_replace(F.regexp_replace(bare, r"^\.", "0."), r"\.(?=$|[eE])", "")
    return (
        F.when(bare.rlike("^0[xX]"), F.when(F.length(digits) <= 16, F.concat(sign, F.conv(digits, 16, 10))).otherwise(F.lit(f'"{MARK}"')))
        .when(bare.isin("Infinity", "NaN"), F.concat(F.lit(f'"{MARK}'), sign, bare, F.lit('"')))
        .otherwise(F.concat(sign, dotted))
    )


def to_json(text: Column) -> Column:
    """``text`` as JSON, if it is JSON5: strings of either quote and with all escapes, comments, bare keys, trailing commas,
    signs, bare points, hex numbers, and ``Infinity`` and ``NaN`` as strings behind ``MARK``. Other text stays no JSON."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    tokens = F.filter(tokens, lambda t: ~t.rlike(rf"^(?:{_COMMENT}|[\s\ufeff]+)$"))

    def joined(tokens: Column) -> Column:
        def put_right(token: Column, i: Column) -> Column:
            before, after = F.get(tokens, i - 1), F.get(tokens, i + 1)
            return (
                F.when(token.rlike(r"""^["'].""") & (F.length(token) > 1), _string(token))
                .when(token.rlike(rf"^{_NAME}$") & (after == ":"), F.concat(F.lit('"'), token, F.lit('"')))
                .when((token == ",") & after.isin("}", "]") & ~before.isin("{", "[", ",", ":"), F.lit(""))
                .when(token.rlike(rf"^{_NUMBER}$"), _number(token))
                .otherwise(token)
            )

        return F.array_join(F.transform(tokens, put_right), " ")

    # as the item of an array the tokens are cut once, however often they are looked at
    return F.get(F.transform(F.array(tokens), joined), F.lit(0))
