"""Operations that prepare a text corpus for training.

Each module holds one operator with a general interface and the query that
applies it to a whole test table.  Nothing else in the library imports this.
"""
