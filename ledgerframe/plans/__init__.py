"""From statement text to a DataFrame: lexer, parser, binder, compiler."""
