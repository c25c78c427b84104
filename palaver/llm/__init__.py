"""Training-data operators: decontamination, quality, licences, tokens, chats, secrets, mixing and near-duplicates.

Nothing outside this subpackage imports it. ``registry`` lists the queries that the driver registers and their SQL.
"""
