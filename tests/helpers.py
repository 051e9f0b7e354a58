def cells(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()) if columns else map(tuple, df.collect()), key=repr)
