"""Training-data operators: token counts, quality scores, packing, fingerprints, mixing, token
files, secret scans, line and near-duplicate removal, exact search. Nothing outside this folder
imports it; it uses general helpers of the library (`session`, `sources`)."""
