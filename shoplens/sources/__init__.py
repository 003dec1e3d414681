"""shoplens.sources"""
