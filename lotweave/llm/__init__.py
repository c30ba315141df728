"""Training-data operators: methods over document, page and embedding tables.

`queries` registers one query per operator; each operator module has its own general interface.
"""
