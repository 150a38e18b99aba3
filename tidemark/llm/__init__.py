"""Training-data operators: deduplication, filtering, fingerprints, mixing.

Nothing outside this subpackage imports it.  Conventions shared by every operator:

* Only the columns an operator names are read; any further column, whatever its
  name, is ignored by operators and passed through by pipeline stages.
* Null text counts as empty text unless the docstring says otherwise.
* Repeated rows are separate documents unless the docstring says otherwise.
* An empty input gives an empty result of the same schema.
"""
