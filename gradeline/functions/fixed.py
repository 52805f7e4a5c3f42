"""Fixed values that native columns and Python functions share; results depend on their exact form."""

#: A choice that names no other choice, in Hebrew or English; case does not matter.
NONE_PATTERN = r"""(?i)(אף\s*אחד\s*מהנ["״׳'`]?\s*ל|none\s+of\s+the\s+above)"""
NONE_OF_THE_ABOVE = "__NONE_OF_THE_ABOVE__"
#: Signs behind which a result stands.
RESULT_SIGNS = r"\\approx|≈|=|\\simeq|→|⇒|\\to\b|\\rightarrow|\\Rightarrow|->"
#: A number as written: sign, decimals, a fraction bar, percent.
NUMBER = r"-?\d+(?:\.\d+)?(?:\s*/\s*\d+(?:\.\d+)?)?%?"
#: The decimals of a number.
DECIMALS = r"\d\.(\d+)"
#: Equality of numbers: relative and absolute tolerance.
REL, ABS = 1e-6, 1e-9
#: Points at which two expressions with names are compared: seed, range of a name's values, tries, points wanted, greatest difference.
SEED, LOW, HIGH, TRIES, POINTS, SPOT = 1729, 0.1, 3.0, 24, 8, 1e-6
#: A respondent's number against the rubric's: exact share, share within which rounding counts.
EXACT, ROUNDING = 1e-6, 0.01
