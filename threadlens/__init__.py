"""threadlens: comment and post analytics expressed as Spark DataFrame plans.

Layout:
  functions/  Column -> Column expressions (cleaner, counters, array maths)
  operators/  DataFrame -> DataFrame steps (lexicon, scaling, encoding,
              scoring, evaluation, run selection, ordered prefix sums)
  sources/    readers and writers (tables, CSV splits, lexicon files,
              run logs, parameter tables)
  plans/      end-to-end compositions and the registered queries
  streaming/  the stateless steps on Structured Streaming
"""

__version__ = "0.1.0"
