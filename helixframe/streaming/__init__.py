"""Operators on streams. Filters, coordinate maps, sequence edits and joins with a static side are
stateless and take a streaming DataFrame as they are; what keeps state is here."""
