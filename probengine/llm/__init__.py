"""Training-data operators on Spark DataFrames (near-duplicates, exact top-k,
quality votes, page text, chat calls, personal data, language-model scores,
byte-level BPE, packing, token counts).

Nothing outside this package imports it. Each module states the defined
result for nulls, empty and very long texts, ties and repeated rows, empty
tables and extra columns."""
