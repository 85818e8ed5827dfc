"""Parameters of the production queries."""

#: Link thresholds, in percent.
JACCARD_PERCENT = 85
COSINE = 0.95

#: Signature values of the near-duplicate search; a low threshold needs more, which are then made.
SIGNATURE = 128
#: Probability at which the bands may miss a pair that is linked, and each batch of the signature comparison drop it.
MISS_PROBABILITY = 1e-9
SIGNATURE_BATCH = 32
#: Rounds of comparisons with one member of a bucket before all open pairs of a bucket are compared.
STAR_ROUNDS = 3
#: Members of a bucket or cell that one task compares with as many others.
BLOCK_ROWS = 2048
#: The same where the rows carry texts.
TEXT_BLOCK_ROWS = 512

#: Labelled rows that a classifier is fitted on, at most.
GAM_ROWS = 20_000
TOXIC_ROWS, UNLABELLED_ROWS = 4_000, 8_000

#: Rows that cost and selectivity of the quality rules are estimated on, about.
RULE_SAMPLE_ROWS = 2_000

#: Rows that the codebooks of the multi-index are fitted on, at most.
CODEBOOK_ROWS = 20_000

#: Cells of the mixing table up to which it is broadcast.
MIX_BROADCAST_CELLS = 50_000
#: Sweeps of raking at most, and the relative change of all totals at which they end.
MIX_SWEEPS, MIX_GAP = 24, 1e-11
#: Given shares of all tokens by margin; other values get theirs from their own share to the power MIX_TEMPER.
MIX_TARGETS = {"lang": {"en": 0.60, "de": 0.14, "fr": 0.14, "es": 0.12}}
MIX_TEMPER = 0.9

#: 64-bit words of the sketch of shared chunks: 8 MB at most.
SKETCH_WORDS = 1 << 20

#: Keys that hold more than one part in so many of the rows are joined by broadcast; there are fewer than this.
HOT_KEYS = 1000

#: Codes of vectors: parts of a vector, entries of a codebook, rounds of learning, integers a unit.
CODE_PARTS, CODE_ENTRIES, CODE_ROUNDS, CODE_SCALE = 16, 64, 2, 256

#: Code points of one stored frame of a text.
FRAME_CHARS = 32_768

#: Tokens of a packed sequence of conversations, after which the next one begins.
PACK_TOKENS = 65_536
