"""Training-data operators: ten corpus operators, their queries and their SQL.

Nothing outside this folder imports it; ``queries.py`` registers one query for each operator.
"""
