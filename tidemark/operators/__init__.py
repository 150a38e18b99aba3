"""DataFrame operators of the ranking engine.

Shared columns: ``request_id`` names a request, ``item`` a candidate, ``cand_pos`` its
place in the order of generation, ``raw`` a signal's value (NULL for no information).
Every operator works on all requests of its input at once.
"""
