"""Lexicons: semantic primes and stop words.

Five primes hold a blank or an apostrophe, so no token of the default tokeniser equals them; they are kept for parity.
"""

from __future__ import annotations

# The prime list.
PRIMES = tuple(
    """above after all another as bad be because before below big body can die do else far feel few good happen hear here i if inside is
    kind know like little live many maybe mine moment more move much near not now one other part people place said say see side small some
    someone something there thing think this time touch true two very want way when where words you""".split()
)
PHRASE_PRIMES = ("a long time", "a short time", "don't want", "for some time", "the same")

# English stop words that tokens can equal; the primes among them are removed below.
ENGLISH_STOP_WORDS = tuple(
    """a about above after again against ain all am an and any are aren as at be because been before being below between both but by can couldn
    d did didn do does doesn doing don down during each few for from further had hadn has hasn have haven having he her here hers herself him
    himself his how i if in into is isn it its itself just ll m ma me mightn more most mustn my myself needn no nor not now o of off on once
    only or other our ours ourselves out over own re s same shan she should shouldn so some such t than that the their theirs them themselves
    then there these they this those through to too under until up ve very was wasn we were weren what when where which while who whom why will
    with won wouldn y you your yours yourself yourselves""".split()
)
STOP_WORDS = tuple(w for w in ENGLISH_STOP_WORDS if w not in PRIMES)
# Punctuation that counts as legal in explications.
LEGAL_PUNCTUATION = ("'", ".", ",", ":", "!", "?", '"', "\n", "\t", "(", ")", "/")
