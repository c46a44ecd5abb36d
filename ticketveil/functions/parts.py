"""Places where a text may be cut without a change to what is done with it."""

from __future__ import annotations

from . import patterns as P

# Before a line that opens an output line whatever stands before it: a label, or the line after an empty one. It does
# not begin with the end of a line-break tag.
LINE_CUT = (
    rf"(?<=\n)(?:(?={P.INLINE_SPACE}*(?![/>])(?:{P.LABEL_LINE[1:]}))"
    rf"|(?<=\n\n)(?={P.INLINE_SPACE}*[^/>\n{P.SPACE_SET}]))"
)

# After a line feed that no rule of redaction reaches over, before a letter. The line ends with a punctuation mark or a
# word in small letters: no name, value, label, prefix or group of digits that the next line could go on with. Its last 16
# characters are letters, marks and single spaces, which the stages before the phone numbers leave as they are, so
# the context of a number in the next line holds no mark of a reference number.
REDACTION_CUT = (
    r"(?<=\n)(?=\p{L})(?<=[.!?;,]\n|[ ][a-z]{1,14}\n)"
    r"(?<=[\p{L}.,'!?; ]{16}\n)(?<![ ]{2}[^\n]{0,14}\n)"
)
