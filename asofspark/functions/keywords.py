"""Word lists of headlines and titles, as data."""

from __future__ import annotations

# Strengths of finance words, from -4 to 4. A headline's score is comparable to scores computed elsewhere
# only with these very words and numbers.
FINANCE_WORDS = """
surge 2.5
surges 2.5
surged 2.5
surging 2.5
soar 2.8
soars 2.8
soared 2.8
soaring 2.8
rally 2.2
rallies 2.2
rallied 2.2
rallying 2.2
jump 2.0
jumps 2.0
jumped 2.0
jumping 2.0
gain 1.5
gains 1.5
gained 1.5
gaining 1.5
rise 1.3
rises 1.3
rose 1.3
rising 1.3
upgrade 2.0
upgrades 2.0
upgraded 2.0
outperform 1.8
buy 1.2
bullish 2.0
beat 1.5
beats 1.5
record 1.3
strong 1.2
growth 1.0
slip -1.8
slips -1.8
slipped -1.8
slipping -1.8
fall -1.8
falls -1.8
fell -1.8
falling -1.8
decline -2.0
declines -2.0
declined -2.0
declining -2.0
plunge -2.8
plunges -2.8
plunged -2.8
plunging -2.8
tumble -2.5
tumbles -2.5
tumbled -2.5
tumbling -2.5
slump -2.3
slumps -2.3
slumped -2.3
downgrade -2.0
downgrades -2.0
downgraded -2.0
underperform -1.8
sell -1.2
bearish -2.0
miss -1.5
misses -1.5
missed -1.5
weak -1.2
concern -1.0
concerns -1.0
crash -2.8
crashes -2.8
crashed -2.8
selloff -2.0
sell-off -2.0
losses -1.5
loss -1.3
cut -1.3
cuts -1.3
default -2.2
recession -2.0
"""

# A title with any of the first and none of the second, anywhere in it, is about an index's members.
TITLE_INCLUDE = ["change", "replacement", "replace", "inclusion", "exclusion"]
TITLE_EXCLUDE = ["fixed income", "sdl", "g-sec", "gsec", "bond", "debt", "money market", "maturity", "launch of", "methodology", "back-testing", "backtesting"]


def finance_strengths() -> dict[str, float]:
    return {word: float(x) for word, x in (line.split() for line in FINANCE_WORDS.split("\n") if line)}
