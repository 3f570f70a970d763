"""Parts of the SQL that the queries are checked against."""


def words_sql(text: str) -> str:
    """The words of a text: runs of characters other than ASCII white space."""
    return rf"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
